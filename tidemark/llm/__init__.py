"""Operators of a training-data pipeline over document, page and conversation tables.

Nothing outside this folder and ``corpus_pipeline.py`` imports it; ``tidemark.llm.queries`` holds the registered queries.
"""
