"""Composite decision operators: each is a plan over the operators, lazy until written."""
