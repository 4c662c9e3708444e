"""Number expressions: coercion, zero-safe rates and means, half-even rounding."""

from __future__ import annotations

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def double(value: float) -> str:
    """A DOUBLE literal (plain ``0.1`` would be a DECIMAL)."""
    return f"{float(value)!r}D"


def identifier(name: str) -> str:
    """A column name as SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def quoted(value: str) -> str:
    """A STRING literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def finite(x: str) -> str:
    """The number, or NULL for NaN and infinities."""
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('Infinity') THEN {x} END"


def to_number(text: str) -> str:
    """Text to DOUBLE; what is not a plain number becomes NULL.

    The pattern is needed because the cast itself accepts suffixes such as ``5d``.
    """
    number = f"try_cast(CASE WHEN {text} RLIKE r'{NUMBER}' THEN {text} END AS DOUBLE)"
    return finite(number)


def mean(total: str, count: str) -> str:
    """``total / count``; 0.0 when ``count`` is 0."""
    return f"coalesce(try_divide(double({total}), double({count})), 0D)"


def rate(part: str, whole: str) -> str:
    """Percentage; 0.0 when there is nothing to divide by."""
    return f"coalesce(try_divide(double({part}), double({whole})) * 100D, 0D)"


def share_of(count: str, fraction: str) -> str:
    """A fraction of a count, rounded half to even and kept between 0 and the count."""
    return f"greatest(0L, least(bigint(bround(double({count}) * {fraction}, 0)), {count}))"
