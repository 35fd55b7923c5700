"""Operators that prepare a training corpus: one module per operator, queries in ``registry``.

Nothing else in the package imports this subpackage.
"""
