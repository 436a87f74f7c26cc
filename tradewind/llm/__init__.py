"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator module has a general interface
(DataFrame in, DataFrame out, real outputs such as texts, spans, ids and files); ``queries`` holds the
registered ``opN_`` queries that derive the digest columns from those outputs.
"""
