"""spanloom: a PySpark-native engine for code-graph analytics."""
