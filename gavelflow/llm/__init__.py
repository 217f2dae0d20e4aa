"""Training-data operators over document corpora, as Spark jobs."""
