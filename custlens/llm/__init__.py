"""Operators of a training-data pipeline.  Nothing outside this subpackage,
``corpus_pipeline.py`` and ``__spark_entry__.py`` refers to it."""
