"""Document catalogues and page sequences on Spark: every operator is a DataFrame or Column function."""
