"""Corpus operators for building training data.

Nothing outside this subpackage imports it; ``queries`` holds the thin
contract queries and ``corpus_pipeline`` at the repository top chains five of
the operators.
"""
