import hashlib
import re

from tillweave.llm import decontam

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_matches_brute_force(table, by_id):
    docs, items = table("documents"), table("benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(w[4] for w in want.values())
    assert by_id(decontam.report(docs, items), *COLS) == want


def test_short_items_shared_windows_and_blocks(spark, make):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (10, passage.upper() + "!"), (2, "lone"), (3, "short item"), (None, "of nobody at all"), (4, None), (5, " .,; "), (3, "other words")]
    docs = [(1, f"x {passage} y"), (2, "Lone, short-item"), (3, "one two three four five six seven eight nine"), (4, None), (5, "of nobody at all other words"), (6, f"{passage} {passage}"), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block_bytes in (decontam.BLOCK_BYTES, 40):
        found = decontam.with_findings(make(docs).select("doc_id", "text"), bench, block_bytes=block_bytes).collect()
        got = {r.doc_id: (r._found.n_words, r._found.n_hit, len({m.item_id for m in r._found.matches})) for r in found}
        assert got == {k: v[:3] for k, v in want.items()}
    longest = {(m.item_id, m.doc_word, m.length) for m in next(r for r in found if r.doc_id == 1)._found.matches}
    assert longest == {("1", 1, 12), ("10", 1, 12)}


def test_hostile_rows(hostile, spark):
    docs, rows = hostile
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 2
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_taken_name_and_split_items(make, spark):
    """A column named like the result stays; rows of one item_id in different blocks are one item."""
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(12))
    docs = make([(1, words("a") + " and " + words("b"), "s"), (2, "nothing of that", "s")]).withColumnRenamed("source", "_found")
    bench = spark.createDataFrame([(None, words("a")), (None, words("b")), (7, words("c"))], "item_id long, text string")
    out = decontam.with_findings(docs, bench, block_bytes=40)
    assert out.columns == [*docs.columns, "_found_"]
    found = {r.doc_id: r["_found_"] for r in out.collect()}
    assert found[1].n_hit == 24 and {m.item_id for m in found[1].matches} == {""} and found[2].n_hit == 0
