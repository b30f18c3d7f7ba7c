"""Column functions, vectorised UDFs and fixed rule values."""
