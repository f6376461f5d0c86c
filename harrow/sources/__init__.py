"""Corpora and query files, in and out."""
