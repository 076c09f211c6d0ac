"""Spark jobs for context governance over many repositories."""
