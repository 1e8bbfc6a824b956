"""Spark-native transcription-quality analytics."""
