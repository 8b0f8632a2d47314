"""Chat formatting: round trips, hostile texts, digests."""

import hashlib
import itertools

from orrery.llm import chat

MARKS = ["[INST] ", " [/INST]", "</s>", "<s>", "\\", "\\0", "\\1", "[", "<", "plain", "ü😀"]


def rows_of(chats):
    return [(c, k, role, text) for c, turns in chats.items() for k, (role, text) in enumerate(turns)]


def test_round_trip(spark):
    texts = ["".join(p) for n in range(3) for p in itertools.product(MARKS, repeat=n)]
    chats = {k: [("user", t), ("assistant", t), ("tool</s>", "")] if k % 3 else [("assistant", t)] for k, t in enumerate(texts)}
    df = spark.createDataFrame(rows_of(chats), "conv_id long, turn int, role string, text string")
    out = chat.format_chats(df)
    found = {r["conv_id"]: r for r in chat.digests(out).collect()}
    formatted = {r["conv_id"]: r for r in out.collect()}
    assert found.keys() == chats.keys()
    for c, turns in chats.items():
        r, f = found[c], formatted[c]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        learnt = "".join(text for role, text in turns if role == "assistant")
        assert r["identical"] and r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] == len(f["formatted"])
    assert not formatted[0]["escaped"] and any(f["escaped"] for f in formatted.values())


def test_awkward_rows(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "a"), (1, 1, None, "a"), (None, None, "assistant", "b"), (2, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, formatted int")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert {c: r["n_turns"] for c, r in found.items()} == {1: 3, None: 1, 2: 1}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"\na\n\na\nuser\n\n").hexdigest()
    assert found[None]["loss_chars"] == 1 and found[2]["loss_chars"] == 0
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversations(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", "</s>" if k == 700 else f"turn [{k}] <") for k in range(1500)] + [(2, 0, "assistant", "x" * 300_000 + "[INST] y"), (2, 0, "assistant", "x" * 300_000 + "[INST] y")]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1]["identical"] and found[1]["escaped"] and [t["text"] for t in found[1]["turns"]] == [r[3] for r in rows[:1500]]
    assert found[2]["identical"] and found[2]["escaped"] == 2 and len(found[2]["turns"]) == 2


def test_every_control_string_is_escaped_where_it_stands(spark):
    """No role or text shows a control string; what has none is left as it is, in the same conversation."""
    texts = ["<s>", "[INST]", "[/INST]", "</s>", "[INST] hi [/INST]<s>", "a < b [c] \\d", "\\1 [", "plain", "<s", "\\"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(k, 1, "assistant", "[plain] <text> \\n") for k in range(len(texts))] + [(50, 0, "[INST]", "as it is"), (50, 1, "a [/INST", "<")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        hostile = any(c in t for c in chat.CONTROLS) or t == "\\1 ["
        assert r["identical"] and r["escaped"] == int(hostile)
        between = r["formatted"].removeprefix("<s>[INST] user [/INST]").partition("</s>")
        assert not any(c in between[0] for c in chat.CONTROLS) and (between[0] == t) == (not hostile)
        assert between[2] == "[INST] assistant [/INST][plain] <text> \\n</s>"
        assert [x["text"] for x in r["turns"]] == [t, "[plain] <text> \\n"]
        s = r["loss"][0]
        assert r["formatted"][s["start"] : s["start"] + s["length"]] == "[plain] <text> \\n"
    assert out[50]["escaped"] == 1 and [(x["role"], x["text"]) for x in out[50]["turns"]] == [("[INST]", "as it is"), ("a [/INST", "<")]
