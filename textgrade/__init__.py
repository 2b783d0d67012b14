"""Text-difficulty analytics as Spark jobs: ingest, token features, folds, models, reports."""
