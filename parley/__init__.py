"""Conversation analytics on Spark: turns, metrics, labels, dispersion and inference as DataFrame plans."""
