"""Structured Streaming extension: ranking of arriving records."""
