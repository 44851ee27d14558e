"""Delimiters and byte order marks of text files, and file types by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
#: First bytes by ending, each (offset, hex); any of a list will do (fixed values).
SIGNATURES = {"pdf": [(0, "255044462D")], "docx": [(0, "504B0304")], "xlsx": [(0, "504B0304")], "png": [(0, "89504E470D0A1A0A")], "jpg": [(0, "FFD8FF")], "jpeg": [(0, "FFD8FF")], "gif": [(0, "474946383761"), (0, "474946383961")], "webp": [(8, "57454250")]}
#: Endings that have no signature.
PLAIN = ("csv", "tsv", "xls")


def delimiter(header: Column) -> Column:
    """Which of DELIMITERS a header line holds most often; a comma if none."""
    counts = [F.struct((F.length(header) - F.length(F.replace(header, F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.greatest(*counts)["d"]


def without_mark(text: Column) -> Column:
    """Without a byte order mark at the beginning."""
    return F.regexp_replace(text, "^﻿", "")


def looks_like(ending: Column, content: Column) -> Column:
    """Whether content begins as files of that ending do; null for endings that aren't known."""
    out = F.when(F.lower(ending).isin(*PLAIN), True)
    for name, signs in SIGNATURES.items():
        hit = F.lit(False)
        for at, sign in signs:
            hit = hit | (F.hex(F.substr(content, F.lit(at + 1), F.lit(len(sign) // 2))) == sign)
        out = out.when(F.lower(ending) == name, hit)
    return out
