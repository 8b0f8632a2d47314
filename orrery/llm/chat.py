"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a rendered conversation::

    chat := "<s>" turn*
    turn := "[INST] " role " [/INST]" text "</s>"

No role or text holds a control string ("<s>", "</s>", "[INST]", "[/INST]") as it stands
there.  Each turn is rendered as it is and parsed again; where a control string lies
within, or the parsed role or text differs from the source, what conflicts is escaped and
parsed once more: that role, or that text, and no other.  Escaping rewrites the characters
that control strings begin with (``\\`` to ``\\0``, ``<`` to ``\\1``, ``[`` to ``\\2``), and the
parser turns these three back wherever they stand, so the second attempt always comes
back identical.  The whole conversation is then parsed and compared with the source.

Input rules: turns are ordered by (turn, role, text), nulls first; null roles and
texts count as empty; repeated rows stay repeated turns; a null conversation id is a
conversation of its own; texts of any length are kept whole; further columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.native import running

OPEN, ROLE_END, CLOSE, BEGIN = "[INST] ", " [/INST]", "</s>", "<s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """Reversible: the result has no control string, and only escapes have a backslash."""
    for char, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in (("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def controlled(text: Column) -> Column:
    """Whether a control string lies in ``text``."""
    return reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in CONTROLS))


def safe(text: Column) -> Column:
    """``text`` as it stands in a rendered turn: as it is where the parser gets it back, else escaped."""
    comes_back = ~controlled(text) & (unescape(text) == text)
    return F.when(comes_back, text).otherwise(escape(text))


def render(turns: Column) -> Column:
    """``turns``: array of struct(role, text), both safe."""
    body = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(ROLE_END), t["text"], F.lit(CLOSE)))
    return F.concat(F.lit(BEGIN), F.array_join(body, ""))


def parse(formatted: Column) -> Column:
    """Array of struct(role, text, start, length): the turns, and where each text lies.

    ``start`` counts code points from 0 and ``length`` the text's as it stands there.  A
    part that the grammar has no place for comes back with a null role.
    """
    head = len(BEGIN)
    body = F.substring(formatted, F.lit(head + 1), F.length(formatted))
    parts = F.split(body, CLOSE, -1)
    parts = F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    )
    # Text begins behind the first " [/INST]"; lengths before it give each part's place.
    cut = F.transform(
        parts,
        lambda p: F.struct(
            p.alias("part"),
            F.when(F.startswith(p, F.lit(OPEN)), F.instr(p, ROLE_END)).otherwise(0).alias("at"),
        ),
    )
    before = running(F.transform(parts, lambda p: F.length(p) + len(CLOSE)), head)

    def turn(c: Column, start: Column) -> Column:
        skip = c["at"] - 1 + len(ROLE_END)
        text = F.substring(c["part"], skip + 1, F.length(c["part"]))
        role = F.substring(c["part"], F.lit(len(OPEN) + 1), c["at"] - 1 - len(OPEN))
        ok = c["at"] > len(OPEN)
        return F.struct(
            F.when(ok, unescape(role)).alias("role"),
            F.when(ok, unescape(text)).otherwise(c["part"]).alias("text"),
            (start + skip).cast("long").alias("start"),
            F.length(text).cast("long").alias("length"),
        )

    return F.zip_with(cut, before, turn)


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant"
) -> DataFrame:
    """One row per conversation: the formatted text, its parsed turns and the loss mask.

    ``loss`` is an array of struct(start, length) over ``formatted``: the texts of the
    ``learner``'s turns, as they stand there.  ``escaped`` tells how many roles and texts
    are escaped, and ``identical`` that the parsed turns equal the source.
    """
    own = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ordered"))
    source = F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (
        chats.select("conv_id", source.alias("source"))
        .withColumn("safe", F.transform("source", lambda t: F.struct(safe(t["role"]).alias("role"), safe(t["text"]).alias("text"))))
        .withColumn("escaped", F.aggregate(F.zip_with("source", "safe", lambda a, b: (a["role"] != b["role"]).cast("int") + (a["text"] != b["text"]).cast("int")), F.lit(0), lambda n, x: n + x))
        .withColumn("formatted", render(F.col("safe")))
        .withColumn("turns", parse(F.col("formatted")))
        .withColumn("identical", plain(F.col("turns")).eqNullSafe(F.col("source")))
        .withColumn(
            "loss",
            F.transform(
                F.filter("turns", lambda t: t["role"] == learner),
                lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
            ),
        )
        .select("conv_id", "formatted", "escaped", "identical", "turns", "loss")
    )


def masked_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the mask, read from the formatted text itself."""
    cut = F.transform(loss, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(cut, unescape), "")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_chats`` made, all read back from its output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = masked_text(F.col("formatted"), F.col("loss"))
    return chats.withColumn("under", under).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )
