"""Reusable DataFrame -> DataFrame steps of the reports."""
