"""Operators for building language-model training corpora, on Spark DataFrames.

Nothing outside this subpackage imports it. Rows of a document table are (doc_id, text, lang, source, ...); every
operator states in its docstring what it does with null, empty and very long texts, ties, repeated rows and empty tables.
"""
