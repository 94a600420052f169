"""Transforms and joins."""
