"""Column functions, all JVM-side.

Most are Spark SQL expressions kept as text and used through ``selectExpr`` or
``F.expr``: one call builds a whole expression, and the same text can be read in
a query plan.
"""
