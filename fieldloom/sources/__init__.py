"""Readers, admission, writers and exports."""
