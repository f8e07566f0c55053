"""Migration and quality engine for legacy business data on Spark."""
