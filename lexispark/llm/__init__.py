"""Operators of a training-data pipeline over corpora of documents.

Each module holds one operator with its own general interface; ``queries``
binds them to the tables of a corpus folder.  Nothing outside this
subpackage imports it.
"""
