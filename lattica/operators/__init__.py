"""lattica.operators."""
