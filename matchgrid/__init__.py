"""Spark-native analytics for head-to-head matchups and their betting markets."""
