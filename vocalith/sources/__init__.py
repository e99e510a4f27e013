"""Readers and writers of manifests, training lists and reports."""
