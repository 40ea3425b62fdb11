"""Registry-analytics building blocks: operators."""
