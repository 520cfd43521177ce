"""hoplens.operators."""
