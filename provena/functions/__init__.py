"""Scalar functions, as columns from columns."""
