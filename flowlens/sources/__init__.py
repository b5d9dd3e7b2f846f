"""Readers and writers: CSV tables, batch envelopes, result directories."""
