"""Revision tracking for engineering drawings, planned and run by Spark."""
