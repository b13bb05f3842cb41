"""Spark-native audit engine for analytics estates: lineage, defect checks and scoring on DataFrames."""
