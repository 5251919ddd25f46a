"""kmerloom: sequence-containment indexing and search as Spark DataFrame jobs."""
