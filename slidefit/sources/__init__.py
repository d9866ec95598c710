"""Signals from files and generators."""
