"""Simulation of dynamic and hybrid systems."""
