"""Whole jobs: the catalog, the corpus, and the registered queries."""
