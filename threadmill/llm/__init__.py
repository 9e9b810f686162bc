"""Operators for training data made from text and vectors."""
