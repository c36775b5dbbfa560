"""Taking rows out of a table by what a decision table names, without moving the rows that stay."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, key_filter


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])


def without(docs: DataFrame, decided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """docs without the rows that decided names; of those that it marks once, one stays.

    decided has id, digest and once, and names each row by its doc_id and the digest
    of its text.  A filter of bounded size tells which rows may be named; only
    their texts are exchanged, all others are passed on where they are read.
    Columns of docs may have any names.  A null id is a value like others.
    """
    ids = key_filter(decided.select(F.xxhash64("id").alias("key")), "key")
    sent = docs.sparkSession.sparkContext.broadcast((ids.bits, ids.data))

    @F.pandas_udf("boolean")
    def named(key: pd.Series) -> pd.Series:
        return pd.Series(KeyFilter(*sent.value).may_have(key.to_numpy(np.int64).view(np.uint64)))

    ident = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), ident.alias("id"), digest(F.col("text").cast("string")).alias("digest"), named(F.xxhash64(ident)).alias("named"))
    some = rows.filter("named")
    out = rows.filter("NOT named").select("row.*").unionByName(some.join(decided, same_row(some, decided), "left_anti").select("row.*"))
    once = decided.filter("once")
    if once.limit(1).count():
        repeated = some.join(once, same_row(some, once), "left_semi")
        out = out.unionByName(repeated.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))
    return out
