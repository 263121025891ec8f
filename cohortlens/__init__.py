"""Cohort and clinical-text analytics as plain Spark DataFrame transformations."""
