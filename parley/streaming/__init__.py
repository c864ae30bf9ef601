"""Chat files as they arrive."""
