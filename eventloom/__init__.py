"""Event quality and adaptation analytics as Spark jobs."""
