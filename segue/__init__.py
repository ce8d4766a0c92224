"""List continuation on Spark: ingest, retrieve, featurise, rank and evaluate."""
