"""sources of the rectangle engine."""
