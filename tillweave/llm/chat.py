"""Chat formatting from event logs.

A log has one row per event: (conv_id, seq, message, kind, role, text). `message` events open a
message with its role and text so far, `delta` events append to it, `edit` events replace its text,
`regenerate` events start its text anew. Editing or regenerating a message also drops the messages
opened after it before that moment, because the conversation went on from there.

Events are folded per message, so a conversation of any length is spread over tasks; only the
narrow rule for dropped messages and the hashing of a whole conversation go along a conversation,
and both stream over its sorted rows with a state of fixed size.

The rendered form of a message is `<|start|>role\\n text <|end|>\\n`. Control strings inside a role or
text get a mark after their first character, and the escape character is doubled, so that no
control string survives and the original comes back exactly. The loss mask covers the texts of
assistant messages.

Defined cases: NULL role or text is empty; a NULL conv_id is a conversation of its own; events of
one seq are ordered by message, kind, role and text; repeated rows are turns of their own where
they open messages; a conversation without messages gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template, and the control strings that texts may not contain as they are.
START, MIDDLE, END = "<|start|>", "\n", "<|end|>\n"
CONTROLS = ["<|start|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED = "assistant"


def _pattern() -> str:
    """Matches the first character of a control string, which is then followed by the mark."""
    return "|".join(f"\\Q{c[0]}\\E(?=\\Q{c[1:]}\\E)" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Backslashes doubled, then `\\:` put after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_pattern()})", r"$1\\:")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|:)", "$1")


def escape_role(role: Column) -> Column:
    """As texts; a line break, which ends the role, is written as `\\n` behind an escape."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A doubled backslash is set aside while `\\n` and marks are read."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\:"), F.lit(""))), "\\")


KINDS = ["message", "delta", "edit", "regenerate"]


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, opened (seq), role, text; dropped ones are left out.

    Within a message, the text starts at its last `message`, `edit` or `regenerate` event and takes
    the deltas after it in order.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # a third of all rows may be one conversation, so messages are the groups here
    one = events.select("conv_id", "message", F.struct("seq", order.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    grouped = one.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("es"))

    def state(a: Column, e: Column) -> Column:
        fresh = e["rank"] != 2  # all but deltas
        return F.struct(
            F.when(fresh, F.array(e["text"])).otherwise(F.concat(a["text"], F.array(e["text"]))).alias("text"),
            F.when(a["role"].isNull(), e["role"]).otherwise(a["role"]).alias("role"),
            F.when(e["rank"].isin(3, 4), e["seq"]).otherwise(a["again"]).alias("again"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("text"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("again"))
    folded = grouped.select("conv_id", "message", F.col("es")[0]["seq"].alias("opened"), F.aggregate("es", zero, state).alias("s"))
    out = folded.select("conv_id", "message", "opened", F.coalesce("s.role", F.lit("")).alias("role"), F.array_join("s.text", "").alias("text"), F.col("s.again").alias("again"))
    # only conversations with an edit or a regeneration need the walk; its rows carry no texts
    restarted = out.filter("again IS NOT NULL").select(F.col("conv_id").alias("_c")).distinct()
    before = Window.partitionBy("conv_id").orderBy("opened", "message").rowsBetween(Window.unboundedPreceding, -1)
    walked = out.select("conv_id", "message", "opened", "again").join(restarted, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    gone = walked.withColumn("last", F.max("again").over(before)).filter("last > opened").select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"))
    return out.join(gone, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message").eqNullSafe(F.col("_m")), "left_anti").drop("again")


def render(messages: DataFrame, order: list[str]) -> DataFrame:
    """A formatted segment per message with the span of its loss mask (code points in the segment).

    A conversation's formatted text is its segments in `order`, one after another.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    trained = F.col("role") == TRAINED
    return messages.select(
        "conv_id", *order, F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(trained, F.length(head)).cast("bigint").alias("loss_start"), F.when(trained, F.length(head) + F.length(body)).cast("bigint").alias("loss_end"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Role and text parsed from a segment, and the text under its loss mask."""
    pattern = rf"^\Q{START}\E([^\n]*)\n([\s\S]*)\Q{END}\E$"
    under = F.substring(F.col("segment"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return segments.withColumns({
        "role": unescape_role(F.regexp_extract("segment", pattern, 1)), "text": unescape(F.regexp_extract("segment", pattern, 2)),
        "loss": F.coalesce(unescape(under), F.lit("")), "chars": F.length("segment").cast("bigint"),
    })


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by conversation and order; the state is two hashes and three counts."""
    done, at, state = [], None, None

    def close() -> tuple:
        conv, n, turns, chars, loss, total = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    for part in parts:
        for conv, role, text, loss, chars in zip(part["conv"], part["role"], part["text"], part["loss"], part["chars"]):
            if state is None or conv != at:
                if state is not None:
                    done.append(close())
                at, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += chars
        yield _frame(done)
        done = []
    if state is not None:
        yield _frame([close()])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=DIGESTS.names)
    ids = pd.array([None if r[0] == "" else int(r[0]) for r in rows], dtype="Int64")
    return out.assign(conv_id=ids)


def digests(read: DataFrame, order: list[str]) -> DataFrame:
    """Counts and digests per conversation, along its sorted turns."""
    kept = read.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), *order, "role", "text", "loss", "chars")
    return kept.repartition("conv").sortWithinPartitions("conv", *order).drop(*order).mapInPandas(_digest, DIGESTS)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as a log: each row opens a message of its own at its turn."""
    key = F.xxhash64("role", "text")
    one = conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.monotonically_increasing_id().alias("_nth"))
    return one.withColumn("message", F.struct(key.alias("key"), F.col("_nth").alias("nth"))).drop("_nth")


def report(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of the hostile one, read back from the formatted output."""
    session = conversations.sparkSession
    hostile = session.createDataFrame([(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    table = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(hostile)
    segments = render(fold(as_events(table)), ["opened", "message"])
    return digests(read_back(segments), ["opened", "message"])


def _control_sql() -> str:
    return "|".join("".join(c if c.isalnum() else "\\" + c for c in x) for x in CONTROLS)


REPORT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(role) + len(text) + len(role || text) - len(replace(role || text, '\\', '')) + len(role) - len(replace(role, chr(10), ''))
  + 2 * (len(regexp_extract_all(role, '{_control_sql()}')) + len(regexp_extract_all(text, '{_control_sql()}'))) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = '{TRAINED}' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn, text), '')) AS loss_sha256,
  CAST(sum(escaped + {len(START + MIDDLE + END)}) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
