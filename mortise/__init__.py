"""mortise: analytics over literature, prediction and structure tables, as Spark jobs."""
