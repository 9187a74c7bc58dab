"""Search over files as they arrive."""
