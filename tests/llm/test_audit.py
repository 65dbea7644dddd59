from fractions import Fraction
from itertools import permutations

from tillweave.llm import audit


def brute(rows, labels):
    """Every order applied to every document, one filter after the other."""
    lab = {}
    for i, q, t in labels:
        lab[i] = (lab.get(i, (0, 0))[0] or q == 1, lab.get(i, (0, 0))[1] or t == 1)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        ws = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == text for o in rows)
        docs.append((lang or "", fails, *map(int, lab.get(i, (0, 0)))))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                fail = sum(d[1][f] for d in own)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fail - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_all_orders_equal_the_simulation(spark):
    long = " ".join(f"word{k}" for k in range(250))
    flat = "again and " * 150
    rows = [(1, long, "en"), (2, long, "en"), (3, long, None), (9, long + " #", "en"), (4, "Short", "en"), (5, flat, "en"), (6, flat + "%", "de"), (7, None, "de"), (8, "", ""), (10, "ABC " * 200, "en"), (11, long.upper(), "de"), (None, long, "en"), (2, long, "en"), (12, flat, "en")]
    labels = [(1, 1, 0), (2, 1, 0), (4, 0, 1), (4, None, 0), (5, 1, 1), (7, 0, 1), (99, 1, 1), (12, None, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string").repartition(3)
    made = got(audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = brute(rows, labels)
    assert len(want) == 3 * 600 and made == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_least_squares_give_shapley_values():
    for n in (2, 3, 5):
        m = audit.shapley_matrix(n)
        v = [Fraction(0), *[Fraction((s * 37 + s * s * 11) % 101) for s in range(1, 1 << n)]]
        want = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            before = 0
            for i in order:
                want[i] += (v[before | 1 << i] - v[before]) / len(orders)
                before |= 1 << i
        assert [sum(c * x for c, x in zip(row, v)) for row in m] == want


def test_whole_table_equals_the_simulation(table):
    docs, labels = table("documents"), table("labels")
    rows, known = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()]
    assert got(audit.audit(docs, labels)) == brute(rows, known)
