"""tokenloom: conversation and prompt analytics as PySpark DataFrame jobs."""
