"""Rental-market and monthly-destination analytics as Spark plans."""
