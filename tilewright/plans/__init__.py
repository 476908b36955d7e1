"""plans of the rectangle engine."""
