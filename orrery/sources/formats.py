"""Formats of small files as Spark data sources: run manifests, archived responses, object listings.

    register(spark)
    spark.read.format("run_manifests").load(folder)

The driver lists the folder and deals its files into partitions by size; executors open
and parse them.  A file that cannot be read as its format gives one row with its ``fault``
and nothing else, so that one broken file hides no other.  Folders may lie wherever
``pyarrow.fs`` reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one partition reads, unless one file is larger.
PARTITION_BYTES = 16 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, source: _Format):
        self.source = source
        self.root = source.options["path"]

    def partitions(self) -> list[Files]:
        files, folder = _opened(self.root)
        found = [f for f in files.get_file_info(pafs.FileSelector(folder, recursive=True)) if f.type == pafs.FileType.File and f.base_name.endswith(self.source.suffixes)]
        parts, size = [], PARTITION_BYTES
        for f in sorted(found, key=lambda f: f.path):
            if size + f.size > PARTITION_BYTES and size:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += max(1, f.size)
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, folder = _opened(self.root)
        width = len(self.source.fields)
        for path in partition.names:
            name = path[len(folder) :].lstrip("/")
            try:
                with files.open_input_stream(path) as f:
                    rows = list(self.source.rows(name, f.read().decode("utf-8")))
            except (ValueError, RecursionError) as error:
                yield (name, *[None] * width, " ".join(str(error).split())[:200] or type(error).__name__)
                continue
            for row in rows:
                yield (name, *row, None)


class _Format(DataSource):
    """A format: its name, the files it takes, its fields, and what it makes of one file's text."""

    title, suffixes, fields = "", (".json",), ()

    @classmethod
    def name(cls) -> str:
        return cls.title

    def schema(self) -> str:
        return ", ".join(["file string", *self.fields, "fault string"])

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError


def _loaded(name: str, text: str) -> object:
    if name.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ValueError("no parser of YAML is installed") from error
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ValueError(f"not YAML: {error}") from error


class RunManifests(_Format):
    """Manifests of runs (manifest.yaml or manifest.json, a folder each) as flat rows; absent fields are null."""

    title, suffixes = "run_manifests", ("manifest.yaml", "manifest.yml", "manifest.json")
    #: A row's fields, and where a manifest keeps each; of several places the first that is filled counts.
    PLACES = {
        "experiment_id": ("experiment.id",), "runtime_id": ("experiment.runtime_id",), "run_date": ("experiment.run_date",), "split": ("experiment.split",),
        "topics": ("data.topics",), "topic_count": ("data.topic_count", "scope.topic_count"), "retriever": ("config.retriever",), "index": ("config.index",),
        "query_source": ("config.query_source",), "hits": ("config.hits", "scope.candidate_depth", "scope.candidate_depths"), "ranking": ("config.ranking",), "evaluation_qrels": ("data.qrels",),
        "output_dir": ("local_artifacts.output_dir",), "cache_dir": ("local_artifacts.cache_dir",), "runfile_rows": ("counts.runfile_rows",), "retrieved_rows": ("counts.retrieved_rows",),
        "rag_rows": ("counts.rag_rows",), "ndcg_at_10": ("metrics.ndcg_at_10",), "recall_at_100": ("metrics.recall_at_100",), "notes": ("notes",),
    }
    #: Fields that name a file: its last part is kept.
    FILES = ("topics", "evaluation_qrels")
    fields = tuple(f"`{f}` string" for f in PLACES)

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        whole = _loaded(name, text)
        if not isinstance(whole, dict):
            raise ValueError("a manifest is a mapping")
        yield tuple(self.text_of(f, next((v for p in places if (v := self.at(whole, p)) not in (None, "", [])), None)) for f, places in self.PLACES.items())

    @staticmethod
    def at(whole: object, place: str) -> object:
        for part in place.split("."):
            whole = whole.get(part) if isinstance(whole, dict) else None
        return whole

    @classmethod
    def text_of(cls, field: str, value: object) -> str | None:
        if value is None:
            return None
        text = ",".join(map(str, value)) if isinstance(value, list) else str(value)
        return text.rsplit("/", 1)[-1] if field in cls.FILES else text


class ArchivedResponses(_Format):
    """Hits of archived responses in the order in which they came, down to the option ``depth`` (100).

    A file is an object with ``topic_id`` and ``response``, whose hits lie under "candidates", "hits" or "results".
    """

    title, fields = "archived_responses", ("topic string", "place int", "docid string", "score double", "text string")

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        from orrery.operators.stores import HIT_FIELDS, hits_of

        whole = json.loads(text)
        if not isinstance(whole, dict) or not isinstance(whole.get("response"), dict) or whole.get("topic_id") in (None, ""):
            raise ValueError("an archive holds topic_id and response")
        if not any(f in whole["response"] for f in HIT_FIELDS):
            raise ValueError("a response holds hits")
        hits, fault = hits_of(json.dumps(whole["response"]))
        if fault:
            raise ValueError(f"malformed response: {fault}")
        for place, hit in enumerate(hits[: int(self.options.get("depth", 100))], 1):
            yield str(whole["topic_id"]), place, hit["doc"], hit["score"], hit["text"]


class ObjectListings(_Format):
    """Entries of object listings: a JSON array, an object that wraps one, or JSON lines; paths must be plain and relative."""

    title, suffixes, fields = "object_listings", (".json", ".jsonl"), ("path string", "size long", "kind string")
    #: Names under which a listing wraps its entries.
    WRAPPERS = ("entries", "files", "items", "objects", "results")

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        if not text.strip():
            return
        try:
            values = [json.loads(text)]
        except ValueError:
            values = [json.loads(line) for line in text.splitlines() if line.strip()]
        for entry in (e for v in values for e in self.entries(v)):
            path = entry.get("path") or entry.get("name")
            parts = path.split("/") if isinstance(path, str) else [""]
            if any(p in ("", ".", "..") for p in parts) or "\\" in path or any(ord(c) < 32 for c in path):
                raise ValueError(f"unsafe path: {path!r}")
            size = entry.get("size")
            yield path, size if isinstance(size, int) and not isinstance(size, bool) else None, None if entry.get("type") is None else str(entry["type"])

    def entries(self, value: object) -> list[dict]:
        if isinstance(value, dict):
            wrapped = next((value[w] for w in self.WRAPPERS if isinstance(value.get(w), list)), None)
            return [value] if wrapped is None else self.entries(wrapped)
        if not isinstance(value, list) or not all(isinstance(e, dict) for e in value):
            raise ValueError("a listing holds objects")
        return value


def register(spark: SparkSession) -> None:
    for kind in (RunManifests, ArchivedResponses, ObjectListings):
        spark.dataSource.register(kind)
