"""Queries over streams of features."""
