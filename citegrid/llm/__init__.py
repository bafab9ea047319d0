"""Operators for training-data pipelines over document, page and conversation tables."""
