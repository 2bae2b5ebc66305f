"""The record store as versioned tables: uploads, corrections, search index and counts."""
