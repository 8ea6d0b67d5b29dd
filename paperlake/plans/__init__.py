"""Whole jobs composed from the operators, and the bindings onto the test tables."""
