"""Spark-native analysis of Java deployment packages, as DataFrames and SQL views."""
