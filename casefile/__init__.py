"""casefile: evidence analytics as composable PySpark DataFrame transformations."""
