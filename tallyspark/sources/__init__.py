"""Readers and writers, and the accounting model over the trade tables."""
