"""Readers, row identity, sampling operators and writers."""
