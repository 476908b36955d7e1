"""operators of the rectangle engine."""
