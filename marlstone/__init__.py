"""Spark-native engine for `.dta` datasets; see README.md."""
