"""Spark-native evaluation of shared-control policies over calibrated posteriors."""
