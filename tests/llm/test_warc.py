"""WARC archives against plain reading and brute force."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest

from helispan.llm import lookup, warc
from helispan.session import shared_path

PAGES = "page_id long, url string, html string, first long, rows int, sha string, path string"


def _record(payload: str) -> str:
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n"


def _payloads() -> list[str | None]:
    rng = random.Random(3)
    fake = _record("inside") + _record("HTTP/1.1 200 OK\r\n\r\nmore")
    out = [None, "", "", "plain", "plain", "plain ", "é ü\n\r\n\r", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    out += ["text\r\n\r\n" + fake, "text\r\n\r\n" + fake * 3, "x" * 5000, "\r\n\r\n" + _record("y" * 700) + "tail", "\r\n\r\nWARC/1.1\r\nno colon here\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"]
    for _ in range(40):
        out.append("".join(rng.choice(["\r\n", "\r\n\r\n", "WARC/1.1\r\n", "Content-Length: 5\r\n", "word ", _record("z")]) for _ in range(rng.randint(0, 12))))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, [f"http://a/{i}", None, "http://b/\r\nX: y"][i % 3], p, 1, 2, "s", "p") for i, p in enumerate(_payloads())]
    return [*out, out[3], (None, None, "plain", 0, 0, None, None), (None, None, "alone", 0, 0, None, None), (None, "u", "alone", 0, 0, None, None), (-7, "u", "neg", 0, 0, None, None)]


def _plain(rows, least=0):
    best: dict[str, int | None] = {}
    for r in rows:
        if r[0] is not None:
            best[r[2] or ""] = max(best.get(r[2] or "", r[0]), r[0])
    out = []
    for r in rows:
        h = (r[2] or "").encode()
        head = best.get(r[2] or "") if len(h) >= least else None
        again = head is not None and r[0] != head
        out.append((r[0], len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("step", "broadcast"), [(1 << 20, 200_000), (64, 200_000), (300, 0)])
def test_round_trip(spark, rows, monkeypatch, step, broadcast):
    monkeypatch.setattr(warc, "RANGE", step)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    assert _got(warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3))) == _plain(rows)


def test_hot_payload(spark, monkeypatch):
    """Copies of one payload are spread; a table beyond the bound of a broadcast is joined by a shuffle."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    rows = [(i, "u", "same" if i % 3 else f"own {i // 6}", 0, 0, "", "") for i in range(3000)]
    assert _got(warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(4))) == _plain(rows)


def test_least_size_and_empty_table(spark, rows):
    path = shared_path(spark, "warc-least")
    warc.write_pages(spark.createDataFrame(rows, PAGES), path, least=5)
    assert _got(warc.digest(warc.read_records(spark, path))) == _plain(rows, 5)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_is_a_chain(spark, rows, monkeypatch):
    """The files read in one pass: headers, lengths and payloads; fields that a reader expects."""
    monkeypatch.setattr(warc, "RANGE", 128)
    path = shared_path(spark, "warc-plain")
    warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(2), path)
    wanted = []
    for name, data in ((r.path, bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect()):
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
            wanted.append((name, at, fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), block.split(b"\r\n\r\n", 1)[1]))
            at = end + 8 + len(block)
            assert data[at - 4 : at] == b"\r\n\r\n"
    got = [(r.path, r.at, r.record_type, r.record_id, r.target_uri, bytes(r.payload)) for r in warc.read_records(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert {r.whole for r in warc.verify(spark, path).collect()} == {True}
    # Ranges hold candidates that the chain does not reach.
    assert warc.candidates(spark, path).count() > len(wanted)


def test_broken_archive(spark, tmp_path):
    """Records up to the damage are read, and the file is told as not whole; an empty file has no row."""
    (tmp_path / "a.warc").write_bytes((_record("one") + _record("two") + "damage\r\n\r\n" + _record("three")).encode())
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(_record("folded").replace("WARC-Type:", "WARC-Type:\r\n ").encode())
    path = f"file://{tmp_path}"
    assert sorted(bytes(r.payload) for r in warc.read_records(spark, path).collect()) == [b"folded", b"one", b"two"]
    assert {r.path.rsplit("/", 1)[1]: r.whole for r in warc.verify(spark, path).collect()} == {"a.warc": False, "c.warc": True}
