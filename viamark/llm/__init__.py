"""Operators over text corpora for training-data pipelines.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
