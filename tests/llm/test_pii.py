import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tillweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@given(st.text(alphabet="aZ0.-@_+% é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_emails_match_the_pattern(text):
    assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]


@given(st.text(alphabet="0159.-+() ", max_size=80))
@settings(max_examples=500, deadline=None)
def test_numbers_match_the_patterns(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    want = [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    want += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    assert sorted(pii.base_spans(text)) == sorted(want)


def test_long_runs_of_digits():
    """Runs beyond the length that int() takes, in time that grows with the text."""
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.2.3.4") == [(0, 5007, "ip")] and pii.base_spans("9" * 5000 + ".2.3.4") == []
    assert pii.base_spans(f"{zeros}.{zeros}.1.255.7.0.0.0") == [(0, 10007, "ip"), (10008, 10015, "ip")]
    start = time.perf_counter()
    for text in ("7" * 1_000_000, "1.2.3 " * 200_000, "1.2." * 250_000, "+1" + " " * 1_000_000, "0" * 500_000 + "." + "0" * 500_000 + ".1.1"):
        pii.spans(text)
    assert time.perf_counter() - start < 10


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_added_spans_need_context_and_room():
    assert [k for _, _, k, _ in pii.spans("my bank account is GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert [k for _, _, k, _ in pii.spans("social security 123-45-6789")] == ["ssn"]
    assert pii.spans("part no 123-45-6789") == []
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert [k for _, _, k, _ in pii.spans(f"token = {token}")] == ["secret"] and pii.spans(f"commit {token}") == []
    assert [k for _, _, k, _ in pii.spans("server address 10.0.0.1")] == ["ip"]


def test_redaction():
    text = "mail a@b.c or +1 (555) 010-9999."
    assert pii.redact(text, pii.spans(text)) == "mail [email] or [phone]." and pii.redact(None, []) is None


def test_report(hostile, table):
    docs, rows = hostile
    got = pii.report(docs).collect()
    assert len(got) == len(rows) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in got)
    assert pii.with_spans(docs.withColumnRenamed("n_words", "pii_spans")).columns[-1] == "pii_spans_"
    assert pii.report(docs.limit(0)).count() == 0
    documents = table("documents")
    for r in documents.join(pii.report(documents), "doc_id").collect():
        base = sorted(pii.base_spans(r.text), key=lambda x: (x[0], pii.BASE.index(x[2])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in base) for k in pii.BASE)
