"""Operators that prepare text and interaction data for language-model training."""
