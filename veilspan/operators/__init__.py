"""Operators of the span algebra."""
