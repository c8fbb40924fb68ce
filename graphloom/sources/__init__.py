"""Readers and sinks: node and edge files, JSON lines, packages, checksums."""
