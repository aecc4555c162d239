"""Market and options analytics as table-in / table-out PySpark operators."""
