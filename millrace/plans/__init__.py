"""Part of millrace: plans."""
