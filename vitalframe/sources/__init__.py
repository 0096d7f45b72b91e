"""vitalframe.sources."""
