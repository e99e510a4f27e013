"""Registered queries, their SQL, and helpers for materialised intermediate tables."""
