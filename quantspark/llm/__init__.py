"""Operators for preparing language-model training corpora, each a Spark job over whole tables."""
