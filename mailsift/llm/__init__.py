"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
derives the registered digest queries from them. Nothing outside this folder
(and ``corpus_pipeline.py``) imports it.
"""
