"""Compression of sample streams."""
