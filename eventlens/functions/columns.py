"""Column helpers: digests, stable buckets, redaction, identifier rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"

#: Words in a column's name that mark its values as sensitive, and names that do so whole.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization")
SENSITIVE_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth_secret", "access_token", "refresh_token", "session_key")
#: Fixed values, applied in this order: private key blocks, bearer and basic headers, JWT-shaped values;
#: then the value after a sensitive key.
HEADERS = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b",
)
KEY_VALUE = r"""(?i)(["']?(?:password|passwd|secret|token|api[_-]?key|apikey|authorization|access[_-]?token)["']?)(\s*[=:]\s*)("[^"]*"|'[^']*'|[^\s,;&}\[\]]+)"""


def content_digest(**cols: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)])), 256)


def ordered_digest(df: DataFrame, by: list[str], item: Column, order: list[str]) -> DataFrame:
    """Per group, SHA-256 of the items in order, joined by a separator that no item holds."""
    rows = F.array_sort(F.collect_list(F.struct(*order, item.cast("string").alias("_item"))))
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["_item"]), RECORD), 256).alias("digest"))


def stable_bucket(*parts: Column, bits: int = 60) -> Column:
    """A number of up to 60 bits from text parts, alike in every process."""
    if bits % 4 or not 4 <= bits <= 60:
        raise ValueError("bits must be a multiple of 4 up to 60")
    return F.conv(F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, bits // 4), 16, 10).cast("long")


def pseudonymous_ref(col: Column) -> Column:
    """First four characters, ``#``, and a short digest."""
    return F.concat(F.substring(col, 1, 4), F.lit("#"), F.substring(F.sha2(col, 256), 1, 8))


def redact(col: Column) -> Column:
    """Key blocks, headers, JWT-shaped values and the values of sensitive keys as [REDACTED]; doing it twice changes nothing."""
    for pattern in HEADERS:
        col = F.regexp_replace(col, pattern, "[REDACTED]")
    return F.regexp_replace(col, KEY_VALUE, "$1$2[REDACTED]")


def redact_columns(df: DataFrame, text: list[str]) -> DataFrame:
    """X5 over a frame: text columns redacted, columns with a sensitive name nulled."""
    out = {c: redact(F.col(c)) for c in text}
    out |= {c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c.lower() in SENSITIVE_NAMES or any(s in c.lower() for s in SENSITIVE)}
    return df.withColumns(out) if out else df


def fixed_places(col: Column, places: int) -> Column:
    """The number with so many decimal places, rounded by its exact binary value and half to even, as C's printf does.

    ``format_string`` rounds the shortest decimal that reads back as the number: 0.14625 is a little less than that.
    """
    return F.replace(F.format_number(col, places), F.lit(","), F.lit(""))


def valid_version(col: Column) -> Column:
    """Upper-case name parts and a numbered version."""
    return F.coalesce(col.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_V[0-9]+$"), F.lit(False))


def valid_pseudonym(col: Column) -> Column:
    """V1: after trimming, 8 to 128 of letters, digits, ``_`` and ``-``."""
    t = F.trim(col)
    return F.coalesce(F.length(t).between(8, 128) & t.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def utc_finding(col: Column) -> Column:
    """V2: null if the text is an instant with offset, else what is wrong with it.

    missing_field, not_a_string (a bare number), invalid_timestamp or naive_timestamp.
    """
    return (
        F.when(col.isNull(), "missing_field")
        .when(col.rlike("^-?[0-9]+(\\.[0-9]+)?$"), "not_a_string")
        .when(F.try_to_timestamp(col).isNull(), "invalid_timestamp")
        .when(~col.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), "naive_timestamp")
    )


def utc_micros(col: Column) -> Column:
    """V2: microseconds of an instant with offset; null where ``utc_finding`` has something to say."""
    return F.when(utc_finding(col).isNull(), F.unix_micros(F.try_to_timestamp(col)))


def valid_unit_interval(col: Column) -> Column:
    """V3: no NaN, and between 0 and 1."""
    return F.coalesce(~F.isnan(col) & col.between(0, 1), F.lit(False))
