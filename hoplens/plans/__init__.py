"""hoplens.plans."""
