"""Part of millrace: sources."""
