"""Training-data operators over documents, pages, vectors and conversations."""
