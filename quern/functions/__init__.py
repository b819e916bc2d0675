"""Scalar functions of columns: float32 arithmetic, bit masks, combinatorics, parsing and names."""
