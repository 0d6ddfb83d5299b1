"""Spark DataFrame operators and jobs for corporate-filings analytics."""
