"""Training-data operators: thirteen DataFrame operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin registered queries, every other module one operator with its own general
interface.
"""
