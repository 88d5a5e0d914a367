"""Readers and writers for documents, matrices, weights, word lists and summaries."""
