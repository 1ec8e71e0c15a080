"""Trusted time-bar analytics on Spark."""
