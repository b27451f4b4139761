"""Whole flows made of operators: corpus, index, search, answers."""
