"""Reconciliation of books and portal statements on Spark."""
