"""Membership by a bitmap of fixed size, so that rows need not move to be told from most others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap.
BITS = 1 << 25


def among(rows: DataFrame, *own: str):
    """A test of columns like ``own``, whether they may be a row of ``rows``: what is one passes always, and few others do."""
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BITS))
    at = rows.select(place(*own).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def there(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 6] >> (at & 63) & 1).astype(bool))

    def test(*columns: Column) -> Column:
        return there(place(*columns))

    return test
