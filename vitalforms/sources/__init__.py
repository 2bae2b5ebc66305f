"""Readers and writers for the file and table formats of the domain."""
