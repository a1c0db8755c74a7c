"""Column helpers shared by the operators."""
