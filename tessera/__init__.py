"""Spark-native analytics over object-detection and segmentation annotations."""
