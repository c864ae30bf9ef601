"""Parley: chat-dataset preparation on Spark."""
