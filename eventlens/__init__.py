"""Behavioural-event analytics on Spark."""
