"""Functions of the span algebra."""
