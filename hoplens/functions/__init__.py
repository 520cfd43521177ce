"""hoplens.functions."""
