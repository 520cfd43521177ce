"""Training-data operators: ten large-scale steps over documents, pages and
embeddings. Nothing else in the library imports this subpackage."""
