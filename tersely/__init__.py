"""Prompt compression and prompt-log analytics on Spark."""
