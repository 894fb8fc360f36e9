"""terrafold: geographic-feature queries and training-data operators on PySpark."""
