"""Operators that prepare text corpora: one module per operator."""
