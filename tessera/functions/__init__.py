"""Subpackage of tessera."""
