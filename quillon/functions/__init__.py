"""Column functions: analysis, scoring, highlighting."""
