"""Part of maskloom."""
