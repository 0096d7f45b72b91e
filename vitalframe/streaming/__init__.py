"""vitalframe.streaming."""
