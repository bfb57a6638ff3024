"""Vacancy analytics as Spark DataFrame and Column functions."""
