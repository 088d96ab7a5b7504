"""Part of millrace: functions."""
