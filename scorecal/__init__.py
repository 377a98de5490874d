"""scorecal: a PySpark-native engine for probability-calibration analytics."""
