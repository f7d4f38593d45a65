"""Sources of the span algebra."""
