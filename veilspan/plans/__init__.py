"""Plans of the span algebra."""
