"""Models: fit on a DataFrame (id, label, s), predict on another (id, s)."""
