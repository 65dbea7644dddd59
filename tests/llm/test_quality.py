import re
from collections import Counter

from tillweave.llm import quality

COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit |= {k, k + 1, k + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_match_brute_force(table, by_id):
    docs = table("documents")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert by_id(quality.report(docs), *COLS) == want


def test_verdicts_follow_the_labels(table):
    docs, labels = table("documents"), table("labels")
    seen = {(r.quality, r.base_failed, r.kept) for r in quality.report(docs).join(labels, "doc_id").collect()}
    assert (1, False, False) not in seen and (0, False, True) not in seen


def test_lines(spark):
    cases = {
        "Home | About | Contact": "navigation", "word### other*** thing$$$ more%%%": "symbols", "---- ==== ----": "punctuation", "READ!! THIS!! NOW!!": "shouting",
        "ALL OF THESE WORDS ARE WRITTEN IN CAPITALS": "shouting", "Read our privacy policy.": "boilerplate", "An ordinary line, with 50% off & more.": None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, line string")
    got = {r.line: r.rule for r in df.select("line", quality.line_fails(df.line).alias("rule")).collect()}
    assert {k: v for k, v in got.items() if k} == {k: v for k, v in cases.items() if k}


def test_hostile_rows(hostile):
    docs, rows = hostile
    out = quality.with_quality(docs)
    assert out.columns == [*docs.columns, "_quality_"]
    got = sorted((r.doc_id or -1, r["_quality_"].n_words, r["_quality_"].kept) for r in out.collect())
    assert got == sorted((i or -1, brute(t)[0], not brute(t)[5]) for i, t, _ in rows)
    assert quality.accepted(docs).columns == docs.columns
    assert quality.report(docs.limit(0)).count() == 0


def test_clean_text(spark):
    df = spark.createDataFrame([("Good line here.\nHome | About | Help\nAnother good line.",)], "text string")
    assert df.select(quality.clean_text(df.text)).first()[0] == "Good line here.\nAnother good line."
