"""Operators of a training-data pipeline over text documents."""
