"""Streaming of the span algebra."""
