"""Keyword intelligence as Spark DataFrame and Column operators."""

__version__ = "0.1.0"
