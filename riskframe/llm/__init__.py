"""Training-data operators: dedup, decontamination, tokenisation, scoring.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded import
in ``__spark_entry__.py``) depends on it.  Operators take DataFrames and
parameters and return DataFrames; ``queries.py`` registers one thin query each.
"""
