"""Spark-native bibliography linkage: parsing, candidate pairs, features, splits, models and statistics."""
