"""Column builders for what SQL operators mean in a dialect, and recursion."""
