"""Analytics over conversation logs and document corpora, written as Spark jobs."""
