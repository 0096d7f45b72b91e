"""vitalframe.functions."""
