"""Retrieval and text analytics over large corpora as Spark jobs."""
