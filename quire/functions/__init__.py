"""Column rules shared by the operators."""
