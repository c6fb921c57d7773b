"""Readers and the declared schemas."""
