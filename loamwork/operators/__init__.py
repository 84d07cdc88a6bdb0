"""Corpus, fact, graph, session and metric operators."""
