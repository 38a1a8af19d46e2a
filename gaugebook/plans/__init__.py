"""Whole jobs: ingest, reports and reconciliation."""
