"""Part of heddle: operators."""
