"""Topics, scores and nested records: readers with explicit schemas, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.text import squeezed, title
from orrery.sources.runs import demand

TOPIC = "id string, title string, narrative string"
CANDIDATE = "topic_id string, variant_name string, retriever_name string, query_text string, docid string, rank bigint, score double, text string"
DOCUMENT_SCORE = "topic_id string, docid string, score double, query_sha256 string, text_sha256 string"
WINDOW_SCORE = "topic_id string, docid string, chunk_index bigint, chunk_count bigint, start_char bigint, end_char bigint, score double, text_sha256 string"
NUGGET_QRELS = "qid string, docid string, nuggets array<struct<id:string,text:string,importance:string,assignment:string>>"
ANSWER = "metadata struct<team_id:string,narrative_id:string,narrative:string,run_id:string,run_desc:string>, references array<string>, answer array<struct<text:string,citations:array<int>>>"
EVENT = "id string, kind string, call_id string, timestamp string, payload string"


def read_topics(spark: SparkSession, path: str, format: str | None = None, title_words: int = 12) -> DataFrame:
    """id, title, narrative from JSON lines or a two-column file; an empty input is an error."""
    kind = format or ("tsv" if path.endswith((".tsv", ".txt")) else "jsonl")
    if kind == "jsonl":
        rows = read_json(spark, path, TOPIC).select(*[squeezed(F.col(c)).alias(c) for c in ("id", "title", "narrative")])
    elif kind == "tsv":
        cut = F.split("value", "\t", 2)
        rows = spark.read.text(path).where(F.trim("value") != "").select(squeezed(cut[0]).alias("id"), squeezed(F.get(cut, F.lit(1))).alias("narrative"))
        rows = rows.select("id", title(F.col("narrative"), title_words).alias("title"), "narrative")
    else:
        raise ValueError(f"unknown topic format: {kind}")
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    for c in ("title", "narrative"):
        blank = blank | (F.coalesce(F.col(c), F.lit("")) == "")
    rows = demand(rows, blank, "a topic has a blank field")
    if rows.isEmpty():
        raise ValueError(f"no topics in {path}")
    return rows


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """id, narrative kept byte for byte; repeated ids, and keys repeated in a line, are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    twice = lambda key: F.regexp_count(F.col("value"), F.lit(f'"{key}"\\s*:')) != 1
    lines = demand(lines, twice("id") | twice("narrative"), "a narrative line must have each key once")
    rows = lines.select(F.from_json("value", "id string, narrative string", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return demand(rows.withColumn("n", n), F.col("n") > 1, "a narrative id occurs twice").drop("n")


def one(df: DataFrame, key: str, value: str) -> DataFrame:
    """The single row with this key; none or several are an error."""
    rows = df.where(F.col(key) == value)
    n = rows.limit(2).count()
    if n != 1:
        raise LookupError(f"{key} {value!r}: {'none' if n == 0 else 'several'}")
    return rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_scores(spark: SparkSession, path: str, schema: str, **expected: str) -> DataFrame:
    """Score artifacts whose metadata columns must equal ``expected`` in every row."""
    rows = read_json(spark, path, schema + "".join(f", {k} string" for k in expected))
    for k, v in expected.items():
        rows = demand(rows, ~F.col(k).eqNullSafe(F.lit(v)), f"a score row has another {k}")
    return demand(rows, F.isnan("score") | F.col("score").isNull(), "a score is missing").drop(*expected)


def read_table(spark: SparkSession, path: str, numeric: tuple[str, ...] = (), separator: str = "\t", required: tuple[str, ...] = ()) -> DataFrame:
    """A file with a header, which must name the ``required`` columns; the numeric ones become doubles, null where they are no numbers."""
    rows = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).csv(path)
    if lacking := [c for c in (*required, *numeric) if c not in rows.columns]:
        raise ValueError(f"the header lacks {', '.join(lacking)}")
    return rows.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in rows.columns])


def read_nuggets(spark: SparkSession, path: str) -> DataFrame:
    """One row per (topic, document, nugget); a topic's nuggets must agree over its documents."""
    rows = read_json(spark, path, NUGGET_QRELS).select("qid", "docid", F.inline("nuggets"))
    texts = rows.groupBy("qid", "id").agg(F.count_distinct("text", "importance").alias("forms"))
    return demand(rows.join(texts, ["qid", "id"]), F.col("forms") > 1, "a nugget differs between documents").drop("forms")


def read_gold_nuggets(spark: SparkSession, path: str) -> DataFrame:
    """topic, nugget (its place, from 1), text, vital: one line per topic, each topic once, texts not blank, importance "vital" or "okay"."""
    rows = spark.read.schema("qid string, nuggets array<struct<text: string, importance: string>>").json(path)
    lines = demand(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid"))), F.col("qid").isNull() | (F.col("n") > 1), "a topic must be named, and once")
    own = lines.select(F.col("qid").alias("topic"), F.posexplode("nuggets").alias("place", "n"))
    own = demand(own, (F.trim(F.coalesce("n.text", F.lit(""))) == "") | ~F.coalesce(F.col("n.importance").isin("vital", "okay"), F.lit(False)), "a gold nugget is malformed")
    return own.select("topic", (F.col("place") + 1).alias("nugget"), F.col("n.text").alias("text"), (F.col("n.importance") == "vital").alias("vital"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """One row per answer sentence with its cited documents in order."""
    rows = read_json(spark, path, ANSWER)
    return rows.select(
        F.col("metadata.narrative_id").alias("topic"), F.col("metadata.run_id").alias("run"), "references", F.posexplode("answer").alias("sentence", "a")
    ).select("topic", "run", "sentence", F.col("a.text").alias("text"), F.transform("a.citations", lambda i: F.get("references", i)).alias("cited"))


def normalise_response(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Search responses of three shapes (candidates, hits, results) as rows with default ranks."""
    hit = "struct<docid:string,id:string,score:double,rank:bigint,text:string,contents:string>"
    shape = f"struct<candidates:array<{hit}>,hits:array<{hit}>,results:array<{hit}>>"
    parsed = F.from_json(payload, shape)
    rows = df.withColumn("p", parsed).withColumn("all", F.coalesce("p.candidates", "p.hits", "p.results", F.array().cast(f"array<{hit}>")))
    return rows.select(*[c for c in df.columns if c != payload], F.posexplode("all").alias("place", "h")).select(
        *[c for c in df.columns if c != payload],
        F.coalesce("h.docid", "h.id").alias("docid"),
        F.coalesce(F.col("h.rank"), F.col("place") + 1).cast("bigint").alias("rank"),
        "h.score",
        F.coalesce("h.text", "h.contents", F.lit("")).alias("text"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Content-addressed texts: a file's name must be the SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([0-9a-f]{64})[^/]*$", 1).alias("digest"), "content")
    return demand(files, F.sha2("content", 256) != F.col("digest"), "a document differs from its digest").select("digest", F.col("content").cast("string").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).csv(path)


def write_keyed(df: DataFrame, path: str, *key: str) -> None:
    """Parquet in ranges of a key that must be unique; Spark's sort spills by itself."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    own = demand(df.withColumn("n", n), F.col("n") > 1, "a key occurs twice").drop("n")
    own.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)


def comparison_tables(df: DataFrame, key: str, name: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(wide, long): one column per name, and one row per (key, name)."""
    wide = df.groupBy(key).pivot(name).agg(F.first(value))
    return wide, wide.unpivot([key], [c for c in wide.columns if c != key], name, value)


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to a schema; a required column that holds a null is an error."""
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    broken = F.lit(False)
    for f in schema:
        if not f.nullable:
            broken = broken | F.col(f.name).isNull()
    return demand(out, broken, "a required column is null")
