"""Scans and sinks: delimited files, workbooks, tables."""
