"""Evidence analytics on Spark: declarative operators over document, mention and assessment tables."""
