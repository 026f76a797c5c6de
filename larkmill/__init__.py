"""Spark-native product analytics: declarative DataFrame operators for text, features, models and corpora."""
