"""Operators for preparing training text on Spark. Nothing else in the package imports this."""
