"""Readers, environments and sinks."""
