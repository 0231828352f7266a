"""Samples in, results out."""
