"""Readers, writers and observation views."""
