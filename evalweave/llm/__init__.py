"""Operators for training-text pipelines; nothing outside this folder imports it."""
