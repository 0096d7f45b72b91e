"""vitalframe.plans."""
