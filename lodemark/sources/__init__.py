"""Readers, writers and derived views."""
