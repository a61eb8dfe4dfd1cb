"""Continuing a finished evaluation with new input tuples."""
