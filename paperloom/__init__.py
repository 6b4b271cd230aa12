"""paperloom: document retrieval and corpus analytics as Spark jobs."""
