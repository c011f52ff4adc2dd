"""Shapes of physical plans shared by the operators."""
