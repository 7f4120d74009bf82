import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewise.llm import warc

from .helpers import SF


def brute(rows):
    groups = {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        first = max((x for x in groups[data] if x is not None), default=None)
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = first is None or i == first
        out.append((i, len(data), sha, "response" if same else "revisit", None if same else first))
    return sorted(out, key=repr)


ROWS = [(1, None), (2, ""), (3, "aé漢\r\n\r\nWARC/1.1\r\n"), (4, "x" * 3000), (5, "x" * 3000), (6, "x" * 3000), (7, "WARC/1.1\r\nContent-Length: 9\r\n\r\n"), (None, "no id"), (8, "é" * 1500), (9, "same"), (9, "same"), (-3, "same")]


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_round_trip_in_chunks_of_any_size(spark, chunk):
    df = spark.createDataFrame([(i, h, 1) for i, h in ROWS], "page_id long, html string, record_type int")
    manifest = warc.archive(df, "page_id", "html", chunk)
    back = warc.read(manifest, chunk, payload=True).cache()
    last = back.where("last").select("record_id", "bytes_so_far", "digest_so_far", "record_type", "refers_to")
    assert sorted(map(tuple, last.collect()), key=repr) == brute(ROWS)
    assert back.agg(F.max(F.length("data"))).first()[0] <= chunk
    whole = {}
    for r in back.where("record_type = 'response'").orderBy("record_id", "chunk").collect():
        whole.setdefault(r["record_id"], []).append(bytes(r["data"]))
    assert b"".join(whole[3]) == "aé漢\r\n\r\nWARC/1.1\r\n".encode() and b"".join(whole[6]) == b"x" * 3000


def test_archives_are_valid_and_damage_is_seen(spark):
    manifest = warc.archive(spark.createDataFrame([(1, "payload " * 50)], "page_id long, html string"), "page_id", "html")
    path = manifest.first()["path"]
    local = path.removeprefix("file://").removeprefix("file:")
    data = gzip.open(local).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n") and manifest.first()["records"] == 1
    with open(local, "wb") as f:
        f.write(gzip.compress(data.replace(b"payload payload", b"payload paylXad", 1)))
    with pytest.raises(Exception, match="payload digest"):
        warc.read(manifest).collect()


def test_sample_pages_and_empty_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert sorted(map(tuple, warc.op2_warc(spark, SF).collect()), key=repr) == brute([(r["page_id"], r["html"]) for r in pages.collect()])
    assert warc.read(warc.archive(pages.limit(0), "page_id", "html")).count() == 0


def test_many_copies_have_one_response(spark):
    rng = random.Random(2)
    rows = [(i, "copy" if i % 3 else f"own {rng.random()}") for i in range(300)]
    got = warc.records_of(spark.createDataFrame(rows, "page_id long, html string"), "page_id", "html")
    assert got.where("record_type = 'revisit'").count() == 199
    assert {r["refers_to"] for r in got.where("record_type = 'revisit'").collect()} == {max(i for i, h in rows if h == "copy")}
