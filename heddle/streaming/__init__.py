"""Part of heddle: streaming."""
