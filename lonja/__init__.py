"""Catalog ETL, data quality and import costing as Spark DataFrame transformations."""
