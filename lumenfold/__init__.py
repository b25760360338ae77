"""Spark-native robust combination, overlap graphs and grouping over many noisy observations."""
