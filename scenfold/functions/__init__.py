"""Column-level functions: scalars, literal tables and the constrained fit."""
