"""Spark-native log analytics: parsing, learned behaviour models and alerts as DataFrame plans."""
