"""Incremental refresh on the file source's checkpoint, and event-time windows."""
