"""Readers, canonicalisation, profiling and writers."""
