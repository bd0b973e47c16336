"""kgspark: knowledge-graph construction and scoring as Spark DataFrame pipelines."""
