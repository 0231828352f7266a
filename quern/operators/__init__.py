"""Alignment, attention pooling, scoring, selection, assembly and chunking as DataFrame operators."""
