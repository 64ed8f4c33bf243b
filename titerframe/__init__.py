"""Assay analytics and training-data preparation as Spark DataFrame programs."""
