"""Training-data operators: counting, filtering, deduplication, scoring and packing of text corpora.

Nothing outside this subpackage imports it, apart from the guarded import in ``__spark_entry__``
and the top-level ``corpus_pipeline``.
"""
