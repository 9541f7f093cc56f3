"""A PySpark-native usage ledger and training-data engine."""
