import hashlib
from collections import defaultdict

import pytest

from mediashoal.llm import warc
from tests.llm.docs import clashing

KIND = "page_id bigint, url string, html string"
BIG = "<p>é" * 500
ROWS = [
    (1, "http://a.example/1", BIG), (2, "http://a.example/2", BIG), (7, None, BIG), (3, "http://b.example/\r\nWARC-Type: forged", "small"), (4, "http://b.example/ü", "small"),
    (5, "", None), (6, "http://c.example", ""), (8, "http://c.example", BIG + "x"), (8, "http://c.example", BIG + "x"), (None, "http://d.example", BIG), (None, None, None), (9, "u", "y" * 200_000),
]


def brute(rows):
    ids = defaultdict(list)
    for i, _, h in rows:
        ids[h or ""].append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in ids[h or ""] if x is not None), default=None)
        again = len(raw) >= 1000 and i != top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_read_back(spark, rows, tmp_path):
    path = warc.write(clashing(spark.createDataFrame(rows, KIND), "payload", "digest", "owner", "size"), f"file://{tmp_path}/w")
    got = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})


def test_records_parse(spark, tmp_path):
    found = {}
    for r in warc.records(warc.read(spark, warc.write(spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/w"))).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body) - 4
        found.setdefault(r["page_id"], (fields, body[:-4]))
    assert found[7][1] == BIG.encode() and "WARC-Target-URI" not in found[7][0]
    assert found[1][1] == b"" and found[1][0]["WARC-Refers-To"] == found[7][0]["WARC-Record-ID"]
    assert found[3][0]["WARC-Type"] == "response"


def test_damage_is_found(spark, tmp_path):
    path = warc.write(spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/w")
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) as payload")
    bad.write.parquet(f"{path}/payloads2")
    import shutil

    shutil.rmtree(tmp_path / "w" / "payloads")
    shutil.move(tmp_path / "w" / "payloads2", tmp_path / "w" / "payloads")
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, path).collect()
