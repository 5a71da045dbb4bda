"""Training-data operators: ten self-contained modules and their registered queries.

Nothing outside this subpackage imports it, except the guarded hook in ``__spark_entry__.py``
and ``corpus_pipeline.py``.
"""
