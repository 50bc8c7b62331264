"""kgweave: build, measure, query and score text knowledge graphs with Spark DataFrames."""

__version__ = "0.1.0"
