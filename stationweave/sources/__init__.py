"""Readers of the raw formats: text lines, delimited files, listings, archives, file trees, and a remote table."""
