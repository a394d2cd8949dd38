"""lattica.sources."""
