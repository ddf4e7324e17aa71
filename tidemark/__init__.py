"""Temporal cohort analytics on Spark: point-in-time features, labels, evaluation, text coding and rule fusion."""
