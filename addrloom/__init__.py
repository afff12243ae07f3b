"""Spark-native standardisation of messy address records."""
