"""Token files against the library's own ids."""

import zlib

import numpy as np
import pytest
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from orrery.llm import bpe, tokens


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(bpe.default_path())
    made.no_truncation()
    made.no_padding()
    return lambda text: np.array([*made.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.fixture
def many_shards(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, was)


def plain(rows, library):
    """(doc_id, start, n, crc) in order of id; documents of equal id in any order."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(t)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: r["start"])


def test_files_hold_what_the_library_says(spark, many_shards, corpus, library, tmp_path):
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None] + [(None, "no id"), (-(1 << 63), "least"), ((1 << 63) - 1, "most </s> end"), (2**40, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(7)
    manifest = tokens.write(df, str(tmp_path / "files"))
    expected = plain(rows, library)
    assert [tuple(r) for r in ordered(tokens.digests(manifest).collect())] == expected
    whole = ordered(tokens.read(manifest).collect())
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["token_ids"])) for r in whole] == expected
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 1 and sum(r["n_ids"] for r in shards) == sum(e[2] for e in expected)
    # Random access by select, and two bytes an id.
    done = 0
    for s in shards:
        files, path = tokens.opened(s["file"])
        with files.open_input_file(path) as source:
            reader = tokens.ShardReader(source)
            assert reader.width == 2
            for k in range(reader.n_docs):
                assert zlib.crc32(reader.tokens(k).astype("<u4").tobytes()) == expected[done][3]
                done += 1
    assert done == len(rows)


def test_repeated_ids_and_blocks(spark, many_shards, library, monkeypatch):
    monkeypatch.setattr(tokens, "READ_BYTES", 64)
    monkeypatch.setattr(tokens, "GROUP", 2)
    rows = [(5, f"text {k % 3} " * (k % 7)) for k in range(40)] + [(k, "b " * k) for k in range(60)]
    found = ordered(tokens.digests(tokens.write(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    expected = plain(rows, library)
    assert [r["doc_id"] for r in found] == [e[0] for e in expected]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((e[0], e[2], e[3]) for e in expected)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


def test_empty_table_and_broken_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert tokens.digests(tokens.write(df.limit(0))).collect() == []
    file = tokens.write(df, str(tmp_path / "one")).first()["file"]
    cut = tmp_path / "cut.ids"
    cut.write_bytes(open(file, "rb").read()[:-1])
    with pytest.raises(ValueError):
        tokens.ShardReader(pafs.LocalFileSystem().open_input_file(str(cut)))
