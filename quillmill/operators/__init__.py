"""Relational operators: tokens and BM25, vector search, fusion, sampling, evaluation."""
