"""Column functions: every scalar rule as a Catalyst expression."""
