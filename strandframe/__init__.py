"""strandframe: a PySpark-native engine for sequencing-read quality control."""
