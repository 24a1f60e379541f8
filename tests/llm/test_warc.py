import base64
import gzip
import hashlib
import os

import pytest

from usagelens.llm import warc

PAGES = [(5, "http://a/é x\ny", "same é"), (3, None, "same é"), (9, "u", None), (8, "u", ""), (7, "http://b", "\r\n\r\nWARC/1.1\r\n"),
         (None, "u", "same é"), (None, "v", "lone"), (11, "u", "x" * 300000), (12, "u", "x" * 300000), (3, "u", "same é")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(h, u, i, "r") for i, u, h in rows], "html string, url string, page_id long, record_type string")


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        html = html or ""
        again = html in first and page != first[html] and len(html.encode()) >= min_bytes
        out.append((page, len(html.encode()), digest(html), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_pages_through_archives(spark, tmp_path, min_bytes):
    got = warc.archived_pages(pages(spark), f"file://{tmp_path}/w", min_bytes=min_bytes).collect()
    assert sorted(map(tuple, got), key=str) == plain(PAGES, min_bytes)


def test_payloads_come_back_and_predicates_are_pushed(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(warc.page_records(pages(spark)), path, file_bytes=2000)
    full = warc.read_archive(spark, path).collect()
    payloads = {bytes(r.payload).decode() for r in full if r.record_type == "response"}
    assert payloads == {h or "" for _, _, h in PAGES}
    assert all(r.payload is None for r in full if r.record_type == "revisit")
    some = warc.read_archive(spark, path, ["record_id", "record_type", "target_uri"]).filter(
        "record_type = 'response' and target_uri like 'http://%'")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert {r.record_id for r in some.collect()} == {"urn:page:7"}
    rest = warc.read_archive(spark, path).filter("payload_bytes > 100000 and record_type in ('response', 'revisit')")
    assert {r.record_id for r in rest.collect()} == {"urn:page:11", "urn:page:12"}


def test_members_are_plain_gzip_and_tell_their_size(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archive(warc.page_records(pages(spark).coalesce(1)).coalesce(1), str(path))
    name, = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    plain_bytes = gzip.decompress((path / name).read_bytes())
    assert plain_bytes.count(b"WARC-Record-ID") == len(PAGES)
    # Archives of other tools: without the extra field, as one stream of members, and not packed at all.
    rows = warc.read_archive(spark, str(path)).collect()
    parts = [warc.record(row.asDict()) for row in rows]
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc.gz").write_bytes(b"".join(gzip.compress(part) for part in parts))
    (other / "b.warc").write_bytes(b"".join(parts))
    again = warc.read_archive(spark, str(other), verify=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows + rows))


def test_wrong_payload_is_found(spark, tmp_path):
    row = {"record_id": "x", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": "A" * 32,
           "refers_to": None, "payload_bytes": 3, "payload": b"abc"}
    (tmp_path / "a.warc").write_bytes(warc.record(row))
    assert warc.read_archive(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


def test_no_pages(spark, tmp_path):
    assert warc.archived_pages(pages(spark, []), str(tmp_path / "w")).collect() == []


def test_appends_add_up_and_overwriting_replaces(spark, tmp_path):
    path = str(tmp_path / "w")
    records = warc.page_records(pages(spark))
    warc.write_archive(records.limit(5), path)
    warc.write_archive(records.limit(3), path)
    assert warc.read_archive(spark, path).count() == 8
    full = [c.split()[0] for c in warc.SCHEMA.split(", ")]
    records.limit(2).select(*full).write.format("warc").mode("overwrite").save(path)
    assert warc.read_archive(spark, path).count() == 2


def test_paths_are_those_of_spark(spark, tmp_path):
    assert warc.qualified(spark, "/a/b") == "file:/a/b"
    assert warc._file_system("file:/a/b")[1] == warc._file_system("/a/b")[1] == "/a/b"
