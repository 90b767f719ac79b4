"""Bibliographic resolution engine on Spark: declarative operators over DataFrames."""
