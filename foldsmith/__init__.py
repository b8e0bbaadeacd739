"""foldsmith: dataset curation and leakage-safe splitting on Spark."""
