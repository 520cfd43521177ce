"""hoplens.sources."""
