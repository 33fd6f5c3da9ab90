"""Streaming of the conversation engine."""
