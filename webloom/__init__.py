"""webloom: crawl analytics and structured extraction as Spark DataFrames."""

__all__ = ["runtime"]
