"""Column helpers: time, text, numbers and order-independent sums.

All of them are built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger import schemas as S

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---------------------------------------------------------------- time

# Fixed format: RFC 3339 with a mandatory offset; a space may replace the T.
RFC3339 = (
    r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]"
    r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
)


def is_rfc3339(text: ColumnOrName) -> Column:
    """Whether the text is a complete RFC 3339 instant of a real calendar day."""
    text = as_col(text)
    return F.coalesce(text.rlike(RFC3339) & parse_ms(text).isNotNull(), F.lit(False))


def parse_ms(text: ColumnOrName) -> Column:
    """RFC 3339 text to epoch milliseconds (toward zero), null when it is not an instant.

    The pattern is tested first because a plain cast also takes date-only, offset-less and
    time-only text.
    """
    text = as_col(text)
    # Fractions beyond microseconds are cut: only whole milliseconds are kept anyway.
    trimmed = F.regexp_replace(F.upper(text), r"(\.\d{6})\d+", "$1")
    micros = F.unix_micros(trimmed.try_cast("timestamp"))
    return F.when(text.rlike(RFC3339), _truncate_thousand(micros))


def _truncate_thousand(micros: Column) -> Column:
    floored = F.floor(micros / F.lit(1000)).cast("bigint")
    inexact = F.pmod(micros, F.lit(1000)) != 0
    return F.when((micros < 0) & inexact, floored + 1).otherwise(floored)


def format_ms(ms: ColumnOrName) -> Column:
    """Epoch milliseconds to RFC 3339 text with three fraction digits."""
    return F.date_format(F.timestamp_millis(as_col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(ms: ColumnOrName, offset_minutes: int | Column = 0) -> Column:
    """Day index of an instant under one UTC offset (floored, also before 1970)."""
    shifted = as_col(ms) + (offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)) * 60_000
    return F.floor(shifted / F.lit(S.DAY_MS)).cast("bigint")


def day_text(day: ColumnOrName) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), as_col(day).cast("int")), "yyyy-MM-dd")


# ---------------------------------------------------------------- text


def sanitize_id(text: ColumnOrName) -> Column:
    """Keep ``[A-Za-z0-9._-]``; an empty result or one led by a dot is prefixed with ``x``."""
    kept = F.regexp_replace(as_col(text), "[^A-Za-z0-9._-]", "")
    return F.when((kept == "") | kept.startswith("."), F.concat(F.lit("x"), kept)).otherwise(kept)


def digest_prefix(text: ColumnOrName, length: int) -> Column:
    return F.substring(F.sha2(as_col(text).cast("binary"), 256), 1, length)


def safe_component(text: ColumnOrName) -> Column:
    text = as_col(text)
    return F.when(text.rlike("^[A-Za-z0-9_-]+$"), text).otherwise(digest_prefix(text, 32))


def stable_id(prefix: str, *parts: ColumnOrName) -> Column:
    """``prefix-<32 hex digits>`` from a tuple; null and empty parts hash differently.

    128 bits of SHA-256, so that no two of very many records are taken for one.
    """
    tagged = [
        F.coalesce(F.concat(F.lit("v"), as_col(p).cast("string")), F.lit("n")) for p in parts
    ]
    return F.concat(F.lit(prefix + "-"), digest_prefix(F.concat_ws("\u001f", *tagged), 32))


def provider_id(text: ColumnOrName) -> Column:
    return F.lower(F.trim(as_col(text)))


def lookup(key: ColumnOrName, table: Mapping[str, object], default=None) -> Column:
    """Map a key through a small fixed table."""
    expr = None
    for name, value in table.items():
        cond = as_col(key) == F.lit(name)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def policy_name(policy_id: ColumnOrName) -> Column:
    """Policy id without its version."""
    return F.substring_index(as_col(policy_id), "/", 1)


# ---------------------------------------------------------------- JSON


def json_text(variant: ColumnOrName, default: str = "") -> Column:
    """A JSON field as text: null, false and absent take the default, strings stay as they are."""
    v = as_col(variant)
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(default))
        .when((kind == "BOOLEAN") & (as_text == "false"), F.lit(default))
        .when(kind == "STRING", as_text)
        .otherwise(F.to_json(v))
    )


def json_flag(variant: ColumnOrName) -> Column:
    """True for JSON ``true`` and for the string ``"true"``, else false."""
    v = as_col(variant)
    kind = F.schema_of_variant(v)
    return F.coalesce(
        kind.isin("BOOLEAN", "STRING") & (F.try_variant_get(v, "$", "string") == "true"), F.lit(False)
    )


def canonical_json(text: ColumnOrName) -> Column:
    """JSON text with recursively sorted keys, so equal content is equal text."""
    return F.to_json(F.try_parse_json(as_col(text)))


# ---------------------------------------------------------------- numbers


def overlap_ms(a_start: ColumnOrName, a_end: ColumnOrName, b_start: ColumnOrName, b_end: ColumnOrName) -> Column:
    span = F.least(as_col(a_end), as_col(b_end)) - F.greatest(as_col(a_start), as_col(b_start))
    return F.greatest(span, F.lit(0).cast("bigint"))


def share(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole``, zero when there is no positive whole."""
    return F.when(as_col(whole) > 0, as_col(part) / as_col(whole)).otherwise(F.lit(0.0))


def clamp(value: ColumnOrName, low: float, high: float) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def is_finite(value: ColumnOrName) -> Column:
    value = as_col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def range_mean(low: ColumnOrName, high: ColumnOrName) -> Column:
    """Mean of a range; half a range, or a non-finite end, has none."""
    low, high = as_col(low), as_col(high)
    return F.when(is_finite(low) & is_finite(high), (low + high) / 2.0)


def kwh_to_joules(kwh: ColumnOrName) -> Column:
    return as_col(kwh) * F.lit(S.J_PER_KWH)


def joules_to_kwh(joules: ColumnOrName) -> Column:
    return as_col(joules) / F.lit(S.J_PER_KWH)


#: Binary exponents of a band of ``exact_sum``, and its first and last band: 2^-108 to 2^108.
_BAND, _BANDS = 36, range(-3, 3)


def exact_sum(value: ColumnOrName) -> Column:
    """Sum of doubles that does not depend on the order rows arrive in; null when there is no value.

    A plain double sum changes in its last bits with the shuffle order, which would make a rebuild of unchanged facts
    look like a change.  Here each value goes to the band of its size, is scaled by a power of two to between 1 and
    2^36 and added in fixed point with 17 fraction digits, which keeps all its digits, is associative and merges
    map-side.  The bands' sums are then added from small to large.  Sizes beyond all bands (2^108 and more, under
    2^-108, infinities and NaN) are added as they come, and so is a band whose fixed-point sum has more than 21 whole
    digits (1.4e10 values at its upper edge or more).
    """
    value = as_col(value)
    size = F.abs(value)
    edges = [F.lit(2.0 ** (_BAND * j)) for j in (*_BANDS, _BANDS.stop)]
    parts = []
    for low, high, j in zip(edges, edges[1:], _BANDS):
        inside = (size >= low) & (size < high)
        scaled = F.when(inside, value * F.lit(2.0 ** (-_BAND * j)))
        exact = F.try_sum(scaled.cast("decimal(38,17)")).cast("double") * F.lit(2.0 ** (_BAND * j))
        parts.append(F.coalesce(exact, F.sum(F.when(inside, value))))
    parts.append(F.sum(F.when(~((size >= edges[0]) & (size < edges[-1])), value)))
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return F.when(F.count(value) > 0, total)


def ordered_counts(entries: ColumnOrName) -> Column:
    """``array<struct<key,n>>`` to ``k=v`` text joined by commas, keys ascending."""
    return F.array_join(
        F.transform(F.sort_array(as_col(entries)), lambda e: F.concat_ws("=", e["key"], e["n"].cast("string"))), ","
    )
