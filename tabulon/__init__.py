"""Tabulon: a Spark-native engine for MySQL-flavoured queries over tabular files."""
