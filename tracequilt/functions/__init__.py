"""Scalar functions as Spark SQL expression text.

Each takes column names (or any SQL expression) and returns an expression for
``F.expr`` / ``selectExpr``.  Text composes freely, is parsed once inside
Spark, and keeps building a plan cheap; everything stays built-in and JVM-side.
"""


def lit(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def all_of(tests: list[str]) -> str:
    return "(" + " AND ".join(tests) + ")" if tests else "true"
