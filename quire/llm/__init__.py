"""Operators for preparing language-model training corpora.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
