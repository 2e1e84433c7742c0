"""Column expressions: no action, no shuffle, no user function."""
