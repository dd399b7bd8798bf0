"""Readers, feed flatteners and sinks."""
