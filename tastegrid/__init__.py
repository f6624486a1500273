"""tastegrid: rating analytics and recommendations as Spark jobs."""
