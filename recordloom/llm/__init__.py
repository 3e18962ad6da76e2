"""Operators for training data built on the library; nothing outside this folder imports it."""
