"""Scalar functions as column expressions: all JVM-side, usable in select, filter and join conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_text(*columns: Column | str) -> Column:
    """One text for a row: fields in the given order, parted by |, nulls as an empty field with a mark.

    The library's own encoding: integers and strings as they are, doubles with a fixed number of decimals, so
    that another engine can write the same text (doubles: see fixed).
    """
    return F.concat_ws("|", *(F.coalesce(_col(c).cast("string"), F.lit("~")) for c in columns))


def fixed(column: Column | str, decimals: int = 6) -> Column:
    return F.format_string(f"%.{decimals}f", _col(column).cast("double"))


def content_hash(*columns: Column | str) -> Column:
    return F.sha2(canonical_text(*columns), 256)


def sealed(hash_column: Column | str, *columns: Column | str) -> Column:
    """Whether a stored hash is that of the other columns."""
    return _col(hash_column).eqNullSafe(content_hash(*columns))


def is_finite(column: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = _col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(array: Column | str) -> Column:
    return F.coalesce(F.forall(_col(array), is_finite), F.lit(False))


def euclid(a: Column, b: Column) -> Column:
    """Distance of two arrays of the same length; arrays of different lengths give null, never a padded result."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares))


def norm(array: Column) -> Column:
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def determinant3(cell: Column) -> Column:
    """Of a 3 x 3 array of arrays."""
    m = lambda i, j: cell[i][j]
    return m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))


def relative_improvement(baseline: Column, candidate: Column, lower_is_better: bool = True) -> Column:
    """0 when the baseline is 0."""
    gain = baseline - candidate if lower_is_better else candidate - baseline
    return F.when(baseline == 0, F.lit(0.0)).otherwise(gain / F.abs(baseline))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def provenance(column: Column | str) -> Column:
    """The text before the first [."""
    return F.substring_index(_col(column), "[", 1)


def normalised_name(column: Column | str, known: Mapping[str, str]) -> Column:
    """Trimmed, inner spaces collapsed, lower case, then looked up; null if unknown."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return table[F.lower(F.regexp_replace(F.trim(_col(column)), r"\s+", " "))]


def classified(column: Column | str, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first pattern that the text matches, case-insensitively."""
    out = None
    for pattern, name in rules:
        hit = F.lower(_col(column)).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def frame_block(snapshot: Column, size: int, first: int = 0) -> Column:
    """The block of a numbered snapshot: blocks of size, numbering from first."""
    return F.floor((snapshot.cast("int") - first) / size).cast("int")


def is_stale(now: Column, created: Column, hours: float) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) > F.lit(int(hours * 3_600_000_000))


# Fixed values (the place before the keyword's run is asked for so that a long run is looked at once): the keyword pattern keeps its first two groups, token patterns are replaced whole.
KEYWORD_SECRET = r"(?i)(?<![a-z0-9_-])([a-z0-9_-]*(?:token|secret|password|passwd|api[_-]?key|bearer|authorization|credential)s?)(\s*[=:]\s*)(\S+)"
TOKEN_SECRETS = (r"\bgh[opsu]_[A-Za-z0-9]{16,}\b", r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\bya29\.[A-Za-z0-9_-]{16,}\b")


def redacted(column: Column | str, mark: str = "[REDACTED]") -> Column:
    text = _col(column)
    out = F.when(text.rlike(r"[=:]"), F.regexp_replace(text, KEYWORD_SECRET, f"$1$2{mark}")).otherwise(text)
    for pattern in TOKEN_SECRETS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
