"""Readers and writers for corpora, page texts, outlines and metadata."""
