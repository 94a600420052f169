"""Domains, generators and tests of models."""
