"""Part of heddle: plans."""
