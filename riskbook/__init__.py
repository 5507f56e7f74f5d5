"""Loan-book risk analytics as Spark DataFrame jobs."""
