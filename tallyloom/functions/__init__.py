"""Expression builders on built-in Spark functions; there is no Python UDF among them.

``text`` builds Columns. ``numeric`` and ``classify`` build SQL expression texts, for
``selectExpr`` and ``expr``: they are nested a lot, and a text is parsed once instead of being
put together call by call.
"""
