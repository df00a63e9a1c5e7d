"""Scalar Column -> Column functions (cleaning, coercion, formatting, rounding)."""
