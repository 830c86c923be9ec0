"""citeflow: a PySpark-native engine for auditing literature collections."""
