"""Spark-native engine for cleaning and profiling sequencing reads."""
