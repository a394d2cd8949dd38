"""lattica.functions."""
