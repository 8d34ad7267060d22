"""Relational operators: scoring, ROC, screening, populations, voting, searches."""
