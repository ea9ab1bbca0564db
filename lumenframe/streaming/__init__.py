"""Structured Streaming forms of the job-pool operators."""
