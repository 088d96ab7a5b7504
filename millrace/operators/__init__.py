"""Part of millrace: operators."""
