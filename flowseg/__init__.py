"""Spark-native segmentation of labelled network flows."""
