"""lattica.plans."""
