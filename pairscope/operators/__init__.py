"""Operators on samples, pairs and histograms."""
