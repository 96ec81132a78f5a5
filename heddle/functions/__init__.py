"""Part of heddle: functions."""
