"""recordloom.streaming."""
