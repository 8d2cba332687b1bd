"""Readers and writers for the input and output tables."""
