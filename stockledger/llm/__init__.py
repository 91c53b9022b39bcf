"""Training-data operators over documents, pages and benchmark items (one module per operator)."""
