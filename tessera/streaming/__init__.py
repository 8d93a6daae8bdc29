"""Incremental maintenance of evaluation results."""
