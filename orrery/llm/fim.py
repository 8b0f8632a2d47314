"""Fill-in-middle transformation over an index of distinct texts.

Identical texts share one boundary list.  The index groups rows by (key, text): the key
only deals rows to tasks, equality is that of the bytes.  Each group's token boundaries
are found once and kept as an Elias-Fano list; the lists are joined back to the documents
by key, and each document selects the two boundaries that its own seeded numbers name.
A key that two different texts share has no entry in the index: its documents make their
own lists, so no cut ever rests on an equal key alone.

The documents are shuffled by key once; both the index and the join read that shuffle.
Only lists move besides.  A text that makes up more than ``1 / HOT_SHARE`` of all rows
(at most ``HOT_SHARE`` texts can) would fill one task: its copies are combined before
they are shuffled for the index, and dealt by (key, salt) for the join.

Tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: white space belongs to
the word behind it, and closing white space is a token of its own.

Input rules: a null text is empty, and comes out plain; a null id is hashed as no digits;
equal rows give equal results each; texts of any length are cut whole; an empty table
gives no rows; other columns are left alone, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.arrow import pieces, texts_of, trim
from orrery.llm.eliasfano import EliasFano, encode

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with more than this share of all rows is hot: one in so many.
HOT_SHARE = 1000
#: Into so many parts are dealt the copies of a text that makes up just that share.
SALTS = 4
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets at which the tokens of ``text`` end."""
    if not text:
        return np.empty(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))


def seeded(id: Column, seed: int) -> list[Column]:
    """Four integers below 2**32 from SHA-256 of "seed:id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, rate: Column, order: Column, fim_percent: int, spm_percent: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.length(text) == 0) | marked | (rate % 100 >= fim_percent)
    return F.when(plain, "plain").when(order % 100 < spm_percent, "spm").otherwise("psm")


def index(keyed: DataFrame, text: Column) -> DataFrame:
    """(_key, _bounds) of each distinct text; keys that stand for several texts are left out.

    Grouping compares whole texts.  Every column is read, if only to be counted, so that
    Spark finds the documents' own shuffle here again and reuses it.
    """
    distinct = keyed.groupBy("_key", text.alias("_text")).agg(*[F.count(keyed[c]).alias(f"_{k}") for k, c in enumerate(keyed.columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                lists = [encode(boundaries(t)) for t in texts_of(part, "_text")]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(lists, pa.binary())], ["_key", "_bounds"])
        trim()

    made = distinct.mapInArrow(run, "_key long, _bounds binary")
    return made.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_bounds").alias("_bounds")).where("_n = 1").drop("_n")


def _pieces_of(text: bytes, bounds: bytes | None, h1: int, h2: int) -> tuple[int, int, int]:
    """(number of tokens, where the prefix ends, where the middle ends), in bytes."""
    found = EliasFano(bounds if bounds is not None else encode(boundaries(text)))
    a, b = sorted((h1 % (len(found) + 1), h2 % (len(found) + 1)))
    return len(found), found.select(a - 1) if a else 0, found.select(b - 1) if b else 0


def _cut(df: DataFrame, out_columns: list[str]) -> DataFrame:
    added = dict(zip(RESULTS, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())))
    schema = T.StructType([*[df.schema[c] for c in out_columns], *[T.StructField(k, v) for k, v in added.items()]])
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = markers
        for batch in batches:
            for part in pieces(batch, "_text", 2 << 20):
                texts, values = texts_of(part, "_text"), [part.column(c).to_pylist() for c in ("_bounds", "_h1", "_h2", "_form")]
                rows = []
                for text, bounds, h1, h2, form in zip(texts, *values):
                    n, a, b = _pieces_of(text, bounds, h1, h2)
                    if form == "plain":
                        rows.append((n, form, None, None, text))
                        continue
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    output = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
                    rows.append((n, form, len(prefix.decode("utf-8")), len(middle.decode("utf-8")), output))
                found = list(zip(*rows))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(v, k) for v, k in zip(found, kinds)]
                arrays[-1] = arrays[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in out_columns], *arrays], [*out_columns, *added])
        trim()

    return df.mapInArrow(run, schema)


def transform(
    df: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, carry: list[str] | None = None
) -> DataFrame:
    """``df`` with n (tokens), form ("plain", "psm" or "spm"), prefix_chars, middle_chars and output.

    Of all texts, ``fim_percent`` in a hundred are cut, and ``spm_percent`` of those put
    the suffix first; the rest, empty texts and texts that hold a marker stay plain.
    ``carry`` names the columns that the result keeps (all of them, unless given).
    """
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in RESULTS]
    at = {c: f"_c{k}" for k, c in enumerate(dict.fromkeys([*kept, id, text]))}
    own = F.coalesce(F.col(at[text]).cast("string"), F.lit(""))
    h1, h2, h3, h4 = seeded(F.col(at[id]), seed)
    keyed = df.select(*[F.col(c).alias(a) for c, a in at.items()]).withColumn("_key", F.xxhash64(own))

    least = max(1, df.count() // HOT_SHARE)
    # Of keys with over a thousandth of all rows, or of repeated ones among few rows, there are fewer than 2 * HOT_SHARE.
    counts = keyed.groupBy("_key").count().where(F.col("count") > least).collect()
    hot = df.sparkSession.createDataFrame([(r["_key"], -(-SALTS * r["count"] // least)) for r in counts], "_key long, _salts long")

    def joined(rows: DataFrame, lists: DataFrame, on: list[str]) -> DataFrame:
        made = rows.join(lists, on, "left").withColumn("_text", own)
        return made.select(*[F.col(at[c]).alias(c) for c in kept], "_text", "_bounds", h1.alias("_h1"), h2.alias("_h2"), form_of(F.col("_text"), h3, h4, fim_percent, spm_percent).alias("_form"))

    cold = (keyed.join(F.broadcast(hot), "_key", "left_anti") if counts else keyed).repartition("_key")
    found = _cut(joined(cold, index(cold, own), ["_key"]), kept)
    if counts:
        copies = keyed.join(F.broadcast(hot), "_key")
        dealt = copies.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts"))).drop("_salts")
        lists = index(copies.drop("_salts"), own).join(F.broadcast(hot), "_key")
        lists = lists.select("_key", "_bounds", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        found = found.unionByName(_cut(joined(dealt, lists, ["_key", "_salt"]), kept))
    return found


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made.  No text that was cut holds a marker, so each is found at its first place."""
    size = len(PREFIX)

    def between(a: Column, b: Column | None) -> Column:
        """What stands behind the marker at ``a``, up to place ``b``."""
        return F.substring(output, a + size, b - a - size if b is not None else F.length(output))

    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = between(m, None)
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
