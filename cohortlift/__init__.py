"""Cohort, campaign-lift and propensity analytics as Spark DataFrame jobs."""
