import hashlib
import re
import struct

import pytest
import zstandard

from estatelens.llm import warc

LONG = "<p>" + "abc def " * 40 + "</p>"


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://h{i % 3}/p{i}", f"<html>{i} {LONG}</html>") for i in range(60)]
    return [*rows, (100, "u", LONG), (101, None, LONG), (99, "w\r\nX: y", LONG), (102, "s", "short"), (103, "s", "short"), (104, "n", None), (None, "null", LONG), (None, None, None), (105, "e", ""), (106, "é", "é" * 5000), (None, "null", LONG), (None, "other", LONG), (107, "long", "<b>" * 300_000)]


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        f = first.get(html) if len(body) >= 100 else None
        again = f is not None and i != f
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=str) == expected(pages)


def test_archives_follow_the_format(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, archive_bytes=8000)
    files = sorted((tmp_path / "w").glob("*.warc.zst"))
    assert len(files) > 2 and not list((tmp_path / "w").glob("part-*")) and all(f.stat().st_size for f in files)
    ids = []
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC
        records = list(warc.records_of(data))
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        heads = [warc.fields(r.partition(b"\r\n\r\n")[0]) for r in records]
        for head, r in zip(heads, records, strict=True):
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head)
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"]) and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"])
            assert int(head["Content-Length"]) == len(r.partition(b"\r\n\r\n")[2]) - 4
            assert head["WARC-Type"] == "warcinfo" or head["WARC-Target-URI"]
            assert head["WARC-Type"] != "revisit" or {"WARC-Profile", "WARC-Refers-To"} <= set(head)
        assert [h["WARC-Type"] for h in heads].count("warcinfo") == 1 and heads[0]["WARC-Filename"] == f.name
        ids += [(h["WARC-Record-ID"], h) for h in heads]
        # any reader that is given the dictionary can read the frames that follow
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
        assert one.decompress(data[8 + size + 8 :]) == records[0]
    assert len(dict(ids)) == len(ids) == len(pages) + len(files)
    assert all(dict(ids)[h["WARC-Refers-To"]]["WARC-Type"] == "response" for _, h in ids if h["WARC-Type"] == "revisit")
    back = warc.read_archives(spark, path)
    texts = {r.page_id: r.payload.decode() for r in back.filter("record_type = 'response' and page_id is not null").collect()}
    assert texts[106] == "é" * 5000 and texts[105] == "" and texts[99] == LONG


def test_other_columns_play_no_part(spark, pages):
    from pyspark.sql import functions as F

    clash = {n: F.lit("x") for n in ("digest", "refers_to", "n", "__key", "__salt", "frame", "value", "payload")}
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns(clash)
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=str) == expected(pages)


def test_the_sample_covers_the_archive():
    assert warc.samples([10] * 2000)[:2] == [0, 4] and warc.samples([10] * 2000)[-1] == 1999 and len(warc.samples([10] * 2000)) == warc.SAMPLES
    assert warc.samples([1, 1, 1]) == [0, 1, 2] and warc.samples([]) == []
    late = [b"early %d " % i + b"a" * 300 for i in range(600)] + [b"late %d " % i + b"the quick brown fox jumps over " * 4 for i in range(600)]
    assert b"quick brown" in next(iter(warc.frames(late)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, digest string, refers_to string")
    assert warc.archive_pages(df).count() == 0


def test_damage_is_noticed():
    good = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2026-01-01T00:00:00Z")
    assert warc.parse(good)[4] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"paYload\r\n"))
