"""Readers and writers of annotation corpora."""
