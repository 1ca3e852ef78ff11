"""Readers, writers and catalogues."""
