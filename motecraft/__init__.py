"""Spark-native analytics for point detections in image batches, with text-corpus operators in `motecraft.llm`."""
