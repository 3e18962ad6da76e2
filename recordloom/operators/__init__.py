"""recordloom.operators."""
