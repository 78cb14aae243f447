"""Landed payloads, change events, resource objects, logs and tables."""
