"""codelattice: a PySpark-native engine for code-intelligence graphs."""
