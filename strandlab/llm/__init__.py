"""Operators for training-data pipelines: documents, pages and embeddings. Nothing outside this folder imports it."""
