"""tessera: Spark-first curation and analysis of image-caption training data."""
