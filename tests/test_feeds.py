"""Outbound feeds come back as they were sent, whatever the transport."""

import pytest
from pyspark.sql import functions as F

from tillweave.sources import feeds

SCHEMA = "id bigint, txt string, amount decimal(12,4), at timestamp, parts array<int>"
HOSTILE = ["plain", "  padded ", 'a "quoted", cell', "tab\tand|bar;semicolon", "<b>&amp;</b>", "naïve – ü 漢字 🙂", "back\\slash", "null", "-", "{}", None, ""]
BREAKS = ["two\nlines", 'one "\nand" two']


def sent(spark, texts):
    rows = [(k - 3 if k else None, s, None if k % 3 == 0 else str(k) + ".1234", None if k % 4 == 0 else "2001-02-03 04:05:06.789", [k]) for k, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, txt string, amount string, at string, parts array<int>")
    return df.withColumns({"amount": F.col("amount").cast("decimal(12,4)"), "at": F.col("at").cast("timestamp")})


@pytest.mark.parametrize("transport", ["CSV", "DELIMITED", "JSON", "XML", "PARQUET", "IDOC", "FIXED_WIDTH"])
def test_round_trip(spark, tmp_path, transport):
    df = sent(spark, HOSTILE if transport == "FIXED_WIDTH" else HOSTILE + BREAKS)
    path = str(tmp_path / "feed")
    feeds.write_feed(df, transport, path)
    back = feeds.read_feed(spark, path, transport, df)
    key = lambda r: tuple("" if v is None else v for v in r)
    trimmed = (lambda v: v.rstrip(" ") if v else v) if transport == "FIXED_WIDTH" else (lambda v: v)  # padding is blanks
    want = sorted((tuple(map(trimmed, r)) for r in feeds.wire_rows(df).collect()), key=key)
    assert back.columns == ["id", "txt", "amount", "at"]
    assert sorted((tuple(r) for r in back.collect()), key=key) == want


@pytest.mark.parametrize("transport", ["CSV", "JSON", "XML", "PARQUET", "FIXED_WIDTH"])
def test_empty_entity(spark, tmp_path, transport):
    df = sent(spark, HOSTILE).filter("false")
    feeds.write_feed(df, transport, str(tmp_path / "feed"))
    assert feeds.read_feed(spark, str(tmp_path / "feed"), transport, df).count() == 0


@pytest.mark.parametrize("text", ["x" * (feeds.TEXT_WIDTH + 1), "two\nlines"])
def test_a_record_that_would_lose_text_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception, match="does not fit"):
        feeds.write_feed(sent(spark, [text]), "FIXED_WIDTH", str(tmp_path / "feed"))


def test_a_feed_is_not_overwritten(spark, tmp_path):
    df = sent(spark, ["a"])
    feeds.write_feed(df, "JSON", str(tmp_path / "feed"))
    with pytest.raises(Exception, match="(?i)exist"):
        feeds.write_feed(df, "JSON", str(tmp_path / "feed"))


def test_every_system_has_a_transport_and_an_entity(t, tmp_path):
    made = feeds.write_feeds(t, str(tmp_path), ["WMS", "CRM", "TMS", "WFM_ROSTER"])
    assert set(made) == {"WMS", "CRM", "TMS", "WFM_ROSTER"} and len(feeds.outbound_entities()) == 18
    for code, path in made.items():
        transport, entity = feeds.outbound_entities()[code]
        df = getattr(t, entity)
        back = feeds.read_feed(t.spark, path, transport, df)
        assert back.exceptAll(feeds.wire_rows(df)).count() == 0 and back.count() == df.count()


@pytest.mark.parametrize("transport", ["CSV", "JSON", "XML", "FIXED_WIDTH"])
def test_text_feeds_are_packed_in_files_of_bounded_size(spark, tmp_path, monkeypatch, transport):
    """Repeated tags and padding do not reach the disk, and no file is larger than one task should read."""
    monkeypatch.setattr(feeds, "FILE_RECORDS", 1000)
    df = spark.range(2500).select("id", F.lit("the same text in every record").alias("txt")).coalesce(1)
    feeds.write_feed(df, transport, str(tmp_path / "feed"))
    files = [p for p in (tmp_path / "feed").iterdir() if p.name.startswith("part-")]
    assert len(files) == 3 and all(p.name.endswith(".gz") for p in files)
    assert sum(p.stat().st_size for p in files) < 2500 * len("the same text in every record") / 2
    assert feeds.read_feed(spark, str(tmp_path / "feed"), transport, df).agg(F.count_distinct("id")).first()[0] == 2500
