"""Detection-event analytics on Spark: from per-frame candidates to trustworthy events."""
