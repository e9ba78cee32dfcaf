"""Readers, staging of report files, validation and sinks."""
