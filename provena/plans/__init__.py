"""Whole pipelines from the operators."""
