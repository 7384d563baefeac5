"""Readers, writers and distributed generators."""
