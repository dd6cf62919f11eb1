"""Operators for preparing training data at scale.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded part of
``__spark_entry__.py`` imports it. Each operator is a module with a general
interface; ``queries.py`` derives the registered result columns from them.
"""
