"""Column-level helpers that other operators share."""
