"""functions of the rectangle engine."""
