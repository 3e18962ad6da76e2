"""recordloom.sinks."""
