"""Line-first cleaning, in DataFrame operations only.

Every line is judged by itself: lines of navigation, of symbols instead of sentences, of shouting
and of boilerplate fail. Failing lines are removed; a document that loses more than `LOST` percent
of its word characters is rejected, as is one that fails the base rules (too few words, or too
many words inside repeated three-word windows).

All counts come from arrays inside the row, so nothing is shuffled. Repeated windows are found by
sorting the row's window digests, in n log n for any length.

Defined cases: NULL and empty texts have no words, counts of 0, and fail; lines without a word are
neither counted nor removed; repeated documents are judged one by one; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.words import SPACE_CLASS, fresh, has_word, let, words

LEAST_WORDS = 50
REPEATED = 50  # percent of words inside repeated windows that a document may have
SHORT_LINE = 200  # characters of a line that a phrase of boilerplate can fail
LOST = 30  # percent of word characters that cleaning may remove

# Symbol characters, separators of navigation, phrases of boilerplate.
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"(?<!\S)[|»›•·>/](?!\S)"
BOILERPLATE = (
    "cookie policy", "accept cookies", "uses cookies", "enable javascript", "javascript is disabled", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "subscribe to our newsletter", "sign up for our", "click here", "read more", "share this", "skip to content", "powered by", "lorem ipsum",
)


def chars(value: Column, pattern: str) -> Column:
    """Code points of `value` that the negated class `pattern` leaves."""
    return F.length(F.regexp_replace(value, pattern, ""))


def line_fails(line: Column) -> Column:
    """Name of the rule that a line breaks, or NULL. Cheap signs come first; most lines show none."""
    n = F.size(words(line))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    symbols = chars(line, r"[^#*$%&|<>]+")
    lower = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | lower.contains(p)
    marked = (
        F.when((separators >= 2) & (n <= 7 * separators), "navigation")
        .when((symbols >= 5) & (symbols * 10 > chars(line, SPACE_CLASS + "+")), "symbols")
    )
    loud = F.regexp_count(line, F.lit("!!"))
    capitals = (n >= 8) & (chars(line, r"\P{Lu}+") * 10 > chars(line, r"\P{L}+") * 7)
    return F.coalesce(
        F.when(line.rlike(r"[#*$%&|<>»›•·/]"), marked),
        F.when(~line.rlike(r"[\p{L}\p{N}]"), "punctuation"),
        F.when(line.contains("!!"), F.when((loud >= 3) & (loud * 4 >= n), "shouting")),
        F.when(line.rlike(r"\p{Lu}{3}"), F.when(capitals, "shouting")),
        F.when((F.length(line) <= SHORT_LINE) & phrase, "boilerplate"),
    )


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            starts = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return let(
                F.sort_array(F.filter(starts, lambda x: x.isNotNull())),
                lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x),
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of counts, verdict, and the cleaned text, from one pass over a text."""
    body = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, has_word)
        failing = F.filter(lines, lambda x: has_word(x) & line_fails(x).isNotNull())
        return F.struct(
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.aggregate(failing, F.lit(0), lambda a, x: a + chars(x, SPACE_CLASS + "+")).cast("bigint").alias("lost_chars"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).cast("bigint").alias("n_repeat_words"))

    return F.struct(
        let(words(body), of_words).alias("words"), let(F.split(body, "\n"), of_lines).alias("lines"),
        chars(body, SPACE_CLASS + "+").cast("bigint").alias("word_chars"), chars(body, r"[^#*$%&|<>]+").cast("bigint").alias("n_symbols"),
    )


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `_quality` of the counts, `base_failed` and `kept`."""
    # a lambda's variable holds the struct, so later uses do not compute it again
    return docs.withColumn(fresh(docs.columns, "_quality"), let(measures(F.col(text)), _judged))


def _judged(m: Column) -> Column:
    n, repeated = m["words"]["n_words"], m["words"]["n_repeat_words"]
    failed = (n < LEAST_WORDS) | (100 * repeated > REPEATED * n)
    return F.struct(
        n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["n_dup_lines"].alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (100 * m["lines"]["lost_chars"] <= LOST * m["word_chars"])).alias("kept"),
        m["lines"]["lost_chars"].alias("lost_chars"),
    )


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~has_word(x) | line_fails(x).isNull()), "\n")


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, their texts without the failing lines, other columns unchanged."""
    def cleaned(q: Column) -> Column:
        return F.when(q["kept"], F.array(F.when(q["lost_chars"] > 0, clean_text(F.col(text))).otherwise(F.col(text))))

    # one text or none from each row, since a filter beside a new column would judge every text twice
    one = F.explode(let(let(measures(F.col(text)), _judged), cleaned))
    return docs.select(*[one.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, whether it fails the base rules, whether it is kept."""
    judged = with_quality(docs.select("doc_id", "text"))
    q = judged.columns[-1]
    return judged.select("doc_id", *[F.col(f"{q}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])
