"""Operators for large-scale training-data preparation.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
this subpackage; deleting those leaves the rest of the library working.
"""
