"""Readers of landed payloads and table sinks."""
