"""Corpus analytics on Spark DataFrames: catalog, retrieval, temporal claims, ingest and text preparation."""
