"""Operators of a training-data pipeline over documents, conversations and embeddings.

Nothing else in the library imports this subpackage; it imports only general helpers.
"""
