"""Streams: tumbling slots, sessions, and merges of micro-batches into tables."""
