"""streaming of the rectangle engine."""
