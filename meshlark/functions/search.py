"""Ranked name search."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Compatibility form without marks, lower-cased and trimmed.  ASCII never leaves the JVM."""
    plain = F.trim(F.lower(text))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_decomposed()(text))


def _decomposed():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c)[0] != "M").lower().strip())

    return run


def collapsed(text: Column) -> Column:
    """normalised(), with arrows, angle brackets, underscores, hyphens and blanks as one space."""
    return F.trim(F.regexp_replace(normalised(text), r"[↔<>_\-\s]+", " "))


def near(query: str, name: Column) -> Column:
    """At most one letter added, left out or changed, for queries of four letters or more."""
    if len(query) < 4:
        return F.lit(False)
    return (F.abs(F.length(name) - len(query)) <= 1) & (F.levenshtein(name, F.lit(query), 1) >= 0)


def ranked(places: DataFrame, query: str, name: str, aliases: str | None = None) -> DataFrame:
    """places with rank: 0 equal, 1 begins with, 2 holds, 3 alias holds, 4 one edit away; others are left out."""
    n = normalised(F.col(name))
    q = " ".join(query.lower().split())
    rank = F.when(F.lit(q == ""), 0).when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2)
    if aliases:
        rank = rank.when(F.exists(aliases, lambda a: normalised_inner(a).contains(q)), 3)
    return places.withColumn("rank", rank.when(near(q, n), 4)).where("rank IS NOT NULL")


def normalised_inner(text: Column) -> Column:
    return F.trim(F.lower(text))
