"""Part of the code-facts engine."""
