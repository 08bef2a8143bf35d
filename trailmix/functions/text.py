"""Name normalisation and tokenisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the character class that equals Python's Unicode whitespace.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# Token pattern and number of token buckets.
TOKEN = r"[a-z0-9]+"
TOKEN_BUCKETS = 8192


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")


def display_name(name: Column) -> Column:
    """Collapse whitespace runs and strip; a missing name is the word ``nan``."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("nan")), WHITESPACE, " "))


def norm_name(name: Column) -> Column:
    """The matching form of a name, used by every metric."""
    return F.lower(display_name(name))


def name_tokens(name: Column) -> Column:
    """Lower-case letter and digit runs of a name."""
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(TOKEN), F.lit(0))


def hash_tokens(name: Column, buckets: int = TOKEN_BUCKETS) -> Column:
    """Token bucket ids by CRC-32; a name without tokens gets bucket 0."""
    ids = F.transform(name_tokens(name), lambda t: F.crc32(t.cast("binary")) % F.lit(buckets))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(0).cast("bigint")))
