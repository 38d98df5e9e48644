"""Competing-risk survival analysis of loan portfolios, written as Spark jobs."""

__version__ = "0.1.0"
