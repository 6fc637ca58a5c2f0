"""Readers and writers of event logs."""
