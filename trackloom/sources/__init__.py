"""Readers and writers for the artifacts of the pipeline."""
