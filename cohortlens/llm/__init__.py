"""Training-data operators: ten Spark operators over documents and embeddings.

Nothing outside this folder imports it, apart from ``__spark_entry__.py`` (which
adds the queries when the folder is there) and ``corpus_pipeline.py``.
"""
