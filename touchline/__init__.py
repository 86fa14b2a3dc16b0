"""Pass-option analytics over football tracking and event data, as Spark jobs."""
