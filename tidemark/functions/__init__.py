"""Column builders shared by the operators: plain expressions, no actions."""
