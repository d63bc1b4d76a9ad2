"""isobar: a PySpark-native engine for storm tracks, gridded fields and moisture budgets."""
