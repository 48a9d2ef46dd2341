"""Monitoring analytics for deployed prediction models, as Spark plans."""
