"""Operators for building training data from documents, pages and embeddings.

Each module holds one operator as a function over DataFrames; ``queries``
applies them to the tables of a data folder.  Nothing outside this
subpackage imports it.
"""
