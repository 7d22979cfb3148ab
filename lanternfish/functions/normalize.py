"""Column expressions that bring spellings of paths and digests to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Single ``/`` as separator, no leading ``./``; null stays null. Regular expressions run only where needed."""
    one = F.translate(path, "\\", "/")
    one = F.when(F.contains(one, F.lit("//")), F.regexp_replace(one, "/+", "/")).otherwise(one)
    return F.when(F.startswith(one, F.lit("./")), F.regexp_replace(one, r"^(\./)+", "")).otherwise(one)


def clean_hash(digest: Column) -> Column:
    """Lower case, no outer blanks, no ``sha256:``; null stays null."""
    plain = F.lower(F.trim(digest, F.lit(" \t\r\n")))
    bare = F.ltrim(F.substring(plain, 8, 2**31 - 1))
    return F.when(F.startswith(plain, F.lit("sha256:")), bare).otherwise(plain)
