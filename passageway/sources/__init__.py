"""Readers and writers: documents, stored collections, run logs."""
