"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
