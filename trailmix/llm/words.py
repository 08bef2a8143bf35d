"""Words, characters and draws shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; null is a key like any other."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a table inside the plan, without a job or Python workers."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(r, kinds, names, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
