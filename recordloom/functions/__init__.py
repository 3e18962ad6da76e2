"""recordloom.functions."""
