"""Learners, models and their evaluation."""
