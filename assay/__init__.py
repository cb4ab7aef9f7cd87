"""Model comparison on tables, as Spark jobs."""
