"""Terms, token estimates and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Trimmed, inner white space made one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize_terms(terms: Column) -> Column:
    """Exact terms: normalised, without empty ones, distinct and in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, collapse), lambda t: t != "")))


def query_terms(text: Column) -> Column:
    """White-space fields of a query and their parts at signs other than _ and -,
    lower case, distinct and in order."""
    fields = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(fields, parts)))


def tokens_of_bytes(text: Column, per_token: int = 4) -> Column:
    return F.ceil(F.octet_length(text) / per_token).cast("long")


def tokens_of_characters(text: Column, per_token: int = 4) -> Column:
    return F.ceil(F.char_length(text) / per_token).cast("long")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def clean_path(path: Column) -> Column:
    """Forward slashes, no empty or single-dot components, no leading slash."""
    parts = F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def framed(*parts: Column) -> Column:
    """Length-prefixed frames (lengths in bytes), which no other parts give."""
    texts = [F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts])


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the SHA-256 of the framed parts."""
    return F.concat(F.lit(f"{prefix}-"), F.sha2(framed(*parts), 256))


def canonical_uuid(domain: str, *parts: Column) -> Column:
    """A version 5 style UUID: the first 16 bytes of a SHA-256 with version and
    variant set."""
    h = F.sha2(F.concat(F.lit(domain), framed(*parts)), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def endpoint_path(*parts: Column) -> Column:
    """Path parts joined by single slashes, with a leading one."""
    joined = F.concat_ws("/", *[F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "") for p in parts])
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "^/|/$", ""))


def dotted_to_path(name: Column, suffix: str) -> Column:
    return F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(suffix))
