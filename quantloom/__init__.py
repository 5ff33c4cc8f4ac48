"""Market-data analytics and strategy validation on Spark."""
