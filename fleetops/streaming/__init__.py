"""Continuously running jobs."""
