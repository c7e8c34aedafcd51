"""Operators for training-data pipelines.  Nothing outside this folder (and
``corpus_pipeline.py``) imports it; ``__spark_entry__.py`` adds its queries
only when it is present."""
