"""Compositions of several operators behind one call."""
