"""Readers, header probes and the relations that queries read."""
