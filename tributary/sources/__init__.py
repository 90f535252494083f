"""Readers and writers of logs, metadata, followers and results."""
