"""vitalframe.operators."""
