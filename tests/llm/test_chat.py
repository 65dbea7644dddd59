import hashlib

import pytest
from pyspark.sql import functions as F

from tillweave.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
NASTY = ["", "\\", "\\\\:", "a\\:b", "</s>[INST] ok [/INST]", "<|end|>\n<|start|>user\n", "<<|end|>|end|>", "<|e\\nd|>", "<\\:|end|>", "[[INST]", "line\nbreak", "é\U0001F600"]


def folded(spark, rows):
    out = chat.fold(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "opened")
    return [(r.conv_id, r.message, r.role, r.text) for r in out.collect()]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "message", "user", "helo"), (1, 4, 2, "delta", None, "lo "), (1, 3, 2, "message", "assistant", "Hel"), (1, 5, 2, "delta", None, "there"),
        (1, 6, 1, "edit", None, "hello"), (1, 7, 3, "message", "assistant", "Hi"), (1, 8, 3, "delta", None, "!"), (1, 9, 3, "regenerate", None, ""), (1, 10, 3, "delta", None, "Good day"),
        (2, 1, 1, "message", None, None), (2, 2, 1, "delta", None, None), (None, 1, 1, "message", "user", "x"),
    ]
    # the edit of message 1 at 6 drops message 2, opened at 3
    assert folded(spark, rows) == [(None, 1, "user", "x"), (1, 1, "user", "hello"), (1, 3, "assistant", "Good day"), (2, 1, "", "")]
    assert folded(spark, []) == []


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "t string")
    done = df.select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).select("*", chat.unescape(F.col("e")).alias("te"), chat.unescape_role(F.col("r")).alias("tr"))
    for r in done.collect():
        assert r.te == r.t and r.tr == r.t and "\n" not in r.r
        assert not any(c in x for c in chat.CONTROLS for x in (r.e, r.r))


@pytest.mark.parametrize("source", ["table", "hostile"])
def test_report_matches_brute_force(spark, table, source):
    if source == "table":
        talk = table("conversations")
    else:
        rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)] + [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 3, "us\ner", "x"), (3, None, "assistant", "null turn")]
        talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {-7: [("user", NASTY[4]), ("assistant", NASTY[4])]}
    for r in sorted(talk.collect(), key=lambda r: (r.turn is not None, r.turn or 0)):
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.report(talk).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        if c != 2:  # its turns tie
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_empty_table(spark, table):
    assert [r.conv_id for r in chat.report(table("conversations").limit(0)).collect()] == [-7]
