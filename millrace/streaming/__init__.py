"""Part of millrace: streaming."""
