"""Readers of logs and feeds, and writers of what detection makes."""
