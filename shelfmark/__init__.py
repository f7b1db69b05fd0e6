"""Catalog, search, selection and export of media assets and documents on Spark DataFrames."""
