import gzip
import hashlib

import pytest

from tabloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def flat(df):
    rows = []
    for r in df.collect():
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        fields = r["metadata"][0]["fields"]
        size = r["response"]["payload_bytes"]
        rows.append((
            fields.get("page-id"), int(fields["payload-bytes"]) if size is None else size, r["response"]["payload_digest"],
            r["response"]["kind"], fields.get("refers-to-page-id"), r["response"]["uri"],
        ))
    return sorted(rows, key=str)


LONG = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5 + "é🙂\r\n\r\n" + "z" * 100
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://a/1", None), (2, "http://a/2\r\nX: y", ""),
    (4, "http://a/4", "y" * 99), (6, "http://a/6", "y" * 99), (7, "http://a/7", "y" * 100), (8, "http://a/8", "y" * 100),
]


def test_round_trip(spark):
    got = {r[0]: r[1:] for r in flat(warc.round_trip(pages(spark, ROWS)))}
    assert len(got) == len(ROWS)
    for page, url, html in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and len(raw) >= 100]
        first = min(same, default=page)
        kind = "response" if first == page else "revisit"
        assert got[str(page)][:4] == (len(raw), hashlib.sha256(raw).hexdigest(), kind, None if first == page else str(first))


def test_payloads_come_back_whole(spark):
    got = warc.round_trip(pages(spark, ROWS), with_payload=True).collect()
    payloads = {r["metadata"][0]["fields"]["page-id"]: bytes(r["response"]["payload"]) for r in got if r["response"]["kind"] == "response"}
    want = {str(p): (h or "").encode() for p, _, h in ROWS}
    assert payloads and all(want[p] == raw for p, raw in payloads.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", LONG), (1, "u", LONG), (None, "n", LONG), (None, "n", "short"), (2, "u", "short")]
    got = flat(warc.round_trip(pages(spark, rows)))
    assert len(got) == len(rows)
    assert [r[3] for r in got if r[0] is None and r[1] > 100] == ["response"]
    assert sum(r[3] == "revisit" for r in got) == 2
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_parser_takes_plain_and_gzipped_and_refuses_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 8\r\n\r\n\r\n\r\nab\r\n\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in warc.parse_records(data)] == [b"\r\n\r\nab\r\n"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-9]))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_chained_pointers(spark):
    rows = [("r", "response", None), ("q", "request", "r"), ("m", "metadata", "q"), ("x", "metadata", "gone")]
    df = spark.createDataFrame(
        [(i, k, c, None, None, None, None, None, None) for i, k, c in rows], warc.RECORDS
    )
    got = {r["capture_id"]: r for r in warc.assemble(df, chained=True).collect()}
    assert len(got["r"]["metadata"]) == 1 and len(got["r"]["requests"]) == 1
    assert got["gone"]["response"] is None and len(got) == 2
