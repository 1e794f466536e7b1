"""Operators for training-data pipelines, each by one stated method."""
