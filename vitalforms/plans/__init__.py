"""End-to-end jobs and the named queries over the analytics tables."""
