"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads whole texts, and keeps its state in Spark or in
tables below the session's ``spark.checkpoint.dir``.
"""
