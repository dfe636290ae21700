"""Comparisons, checks and reports built from the operators."""
