"""Spark-native analysis of mail and identity evidence."""
