"""Registered queries, experiments and reports."""
