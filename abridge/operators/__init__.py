"""Relational operators: bags, idf, similarity measures, combination, clustering, selection."""
