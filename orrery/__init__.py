"""A Spark-first engine for catalogues with embedding vectors, and for training-data pipelines."""
