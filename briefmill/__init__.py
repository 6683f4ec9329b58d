"""Evidence analytics over large document collections, expressed as Spark DataFrame jobs."""
