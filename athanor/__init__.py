"""A PySpark-native engine for rule-driven transformation of molecular graphs."""
