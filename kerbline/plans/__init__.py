"""Composite jobs: posting to the fact table and reports."""
