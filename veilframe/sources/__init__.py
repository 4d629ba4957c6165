"""Readers, sinks and upload processing."""
