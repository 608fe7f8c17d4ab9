"""Query catalogue: Spark plans and, where SQL can say the same, their SQL."""
