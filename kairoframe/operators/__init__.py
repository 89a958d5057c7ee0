"""Operators over signals and events."""
