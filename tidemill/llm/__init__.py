"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage; its queries are registered
by ``__spark_entry__.py`` when the subpackage is there.
"""
