"""Operators for preparing large text corpora for model training."""
