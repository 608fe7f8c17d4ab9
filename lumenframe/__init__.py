"""Spark-native analytics over medical-imaging (DICOM) data."""
