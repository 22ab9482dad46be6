"""Catalith: catalog queries and data-processing operators over PySpark DataFrames."""
