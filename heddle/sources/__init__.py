"""Part of heddle: sources."""
