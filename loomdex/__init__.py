"""Loomdex: a Spark-native search, indexing and corpus-processing engine."""
