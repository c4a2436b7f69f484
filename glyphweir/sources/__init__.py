"""Readers and writers of the text and table formats."""
