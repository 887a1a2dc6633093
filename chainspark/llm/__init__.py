"""Operators for training-data pipelines: scoring, deduplication, decontamination, scans."""
