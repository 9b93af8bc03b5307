"""Operators for preparing text corpora for model training.

Nothing outside this package imports it. ``tessera.llm.queries`` registers one
query per operator; ``corpus_pipeline.py`` chains five of them.
"""
