"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this package.  ``queries.py`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains
five of them.
"""
