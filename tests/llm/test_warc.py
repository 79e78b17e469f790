import base64
import gzip
import hashlib

import pytest

from quire.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/", "same ünï"), (2, None, "same ünï"), (3, 'x\r\ny"z\\', "same ünï"), (4, "u", None), (5, "u", ""),
    (6, "http://b/", "b\r\n\r\nb" * 400), (7, "q", "z" * 3_000_000), (8, "only", "once"), (None, "n", "no id"),
    (None, "n", "same ünï"), (9, "r", "twice"), (9, "r", "twice"), (None, "n", "none at all"), (None, "n", "none at all"),
]


def expected(rows, least=0):
    best = {}
    for page_id, _, html in rows:
        if page_id is not None:
            best[html or ""] = max(best.get(html or "", page_id), page_id)
    for page_id, _, html in rows:
        data = (html or "").encode()
        full = best.get(html or "")
        again = len(data) >= least and full is not None and page_id != full
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        yield page_id, len(data), digest, "revisit" if again else "response", full if again else None


def test_round_trip_equals_brute_force(table):
    got = [tuple(r) for r in warc.round_trip(table(ROWS, PAGES, extra=True)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(ROWS)))


@pytest.fixture(scope="module")
def archive(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    warc.archive(table(ROWS, PAGES, files=2), path, least_bytes=5, max_file_bytes=2000)
    return path


def test_payloads_urls_and_rolled_files(spark, archive):
    full = warc.read(spark, archive)
    assert full.rdd.getNumPartitions() > 2
    rows = full.collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == sorted(
        map(str, expected(ROWS, 5)))
    assert sorted(str((r.page_id, r.url)) for r in rows) == sorted(str(r[:2]) for r in ROWS)
    texts = {r[0]: r[2] for r in ROWS if r[0] is not None}
    for r in rows:
        if r.record_type == "revisit":
            assert r.payload is None
        elif r.page_id is not None:
            assert bytes(r.payload).decode() == (texts[r.page_id] or "")


def test_files_are_plain_gzip_members(archive, tmp_path):
    from pathlib import Path

    texts = [gzip.open(p).read() for p in Path(archive).glob("*.warc.gz")]
    assert sum(t.count(b"WARC/1.1\r\n") for t in texts) == len(ROWS)
    assert all(t.startswith(b"WARC/1.1\r\nWARC-Type: ") and t.endswith(b"\r\n\r\n") for t in texts)


def pushed(spark, path, condition):
    """A frame for one plan."""
    return spark.read.format("warc").option("push_filters", "true").load(path).filter(condition)


def test_header_predicates_go_to_the_reader(spark, archive):
    warc.register(spark)
    frame = pushed(spark, archive, "record_type = 'revisit' AND refers_to IN (3) AND page_id IS NOT NULL")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert sorted(r.page_id for r in frame.collect()) == [1, 2]
    assert pushed(spark, archive, "payload_bytes > 1000").count() == 2
    assert pushed(spark, archive, "refers_to IS NULL AND record_type = 'revisit'").count() == 0


def test_predicates_by_value_and_frames_used_twice(spark, archive):
    got = warc.read(spark, archive, "page_id long", {"record_type": ["revisit"], "refers_to": [3]}).collect()
    assert sorted(r.page_id or 0 for r in got) == [0, 1, 2]
    assert warc.read(spark, archive, where={"url": [None, "q"], "record_type": ["response"]}).count() == 1
    assert warc.read(spark, archive, where={"page_id": []}).count() == 0
    with pytest.raises(ValueError, match="payload"):
        warc.read(spark, archive, where={"payload": [b""]})
    frame = warc.read(spark, archive, "page_id long, record_type string")
    one, two = frame.filter("page_id = 1"), frame.filter("page_id = 2")
    assert sorted(r.page_id for r in one.unionByName(two).collect()) == [1, 2]
    assert (one.count(), frame.count(), two.count(), frame.filter("page_id = 9").count()) == (1, len(ROWS), 1, 2)


def test_unwanted_payloads_are_not_inflated():
    data = warc.member(warc.record(1, "u", b"x" * 5_000_000, None))
    row, start, rest = warc.WarcReader._record(data[warc._HEAD.size :])
    assert row["payload_bytes"] == 5_000_000 and row["page_id"] == 1
    assert rest()[start:-4] == b"x" * 5_000_000


def test_empty_table_and_files_without_manifest(spark, table, archive, tmp_path):
    path = str(tmp_path / "none")
    warc.archive(table([], PAGES), path)
    assert warc.read(spark, path).count() == 0
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(archive, copy)
    (copy / warc.MANIFEST).unlink()
    assert warc.read(spark, str(copy)).count() == len(ROWS)


BIG = b"y\r\n\r\ny" * 200_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: " + b"v" * 3000 + b"\r\n\r\n"
#: type, id, further headers, block, bytes of the block before the payload
FOREIGN = [
    ("warcinfo", "<urn:uuid:0>", "Content-Type: application/warc-fields", b"software: x\r\n\r\nmore: y\r\n", 0),
    ("request", "<urn:uuid:1>", "Content-Type: application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", 27),
    ("response", "<urn:uuid:2>", "content-type:application/http\r\nWARC-Target-URI:  <http://a/%22\\x> \r\n"
     "WARC-Payload-Digest: sha256:AB", HTTP + BIG, len(HTTP)),
    ("response", "<urn:uuid:3>", "Content-Type: application/http\r\nWARC-Target-URI: http://b/\r\nX-Folded: one\r\n  two",
     b"HTTP/1.0 200 OK\nServer: y\n\nbody", 27),
    ("response", "<urn:uuid:4>", "Content-Type: application/http", b"a block without HTTP headers", 0),
    ("revisit", "<urn:uuid:5>", "Content-Type: application/http\r\nWARC-Refers-To: <urn:uuid:2>\r\n"
     "WARC-Payload-Digest: sha1:ABC", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", 39),
    ("revisit", "<urn:uuid:6>", "X: y", b"", 0),
    ("resource", "<urn:uuid:7>", "Content-Type: image/png", bytes(range(256)) * 300, 0),
    ("metadata", "<urn:uuid:8>", "Content-Type: text/plain", b"", 0),
]


def foreign(kind, urn, more, block):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {urn}\r\n{more}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def foreign_rows():
    url = {"<urn:uuid:2>": "http://a/%22\\x", "<urn:uuid:3>": "http://b/"}
    for kind, urn, more, block, start in FOREIGN:
        size = 77 if urn == "<urn:uuid:5>" else None if kind == "revisit" else len(block) - start
        digest = {"<urn:uuid:2>": "sha256:AB", "<urn:uuid:5>": "ABC"}.get(urn)
        refers = "<urn:uuid:2>" if urn == "<urn:uuid:5>" else None
        yield None, url.get(urn), kind, None, size, digest, None if kind == "revisit" else block[start:], urn, refers


@pytest.mark.parametrize("form", ["members", "padded", "one member", "sized members", "plain", "mixed"])
def test_archives_of_other_makers(spark, tmp_path, form):
    records = [foreign(*r[:4]) for r in FOREIGN]
    if form == "members":
        data = b"".join(map(gzip.compress, records))
    elif form == "padded":
        data = b"\0\0".join(map(gzip.compress, records)) + b"\0" * 600_000
    elif form == "one member":
        data = gzip.compress(b"".join(records))
    elif form == "sized members":
        data = b"".join(map(warc.member, records))
    elif form == "mixed":
        data = b"".join(map(warc.member, records[:3])) + b"".join(map(gzip.compress, records[3:]))
    else:
        data = b"".join(records)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    name = tmp_path / "deep" / "er" / ("x.warc" if form == "plain" else "x.warc.gz")
    name.write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no archive")
    expected = sorted(map(str, foreign_rows()))
    columns = warc.SCHEMA.removesuffix(", content_type string")
    for path in (tmp_path, name):
        got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in warc.read(spark, str(path), columns).collect()]
        assert sorted(map(str, got)) == expected
    short = warc.read(spark, str(tmp_path), "record_type string, record_id string, payload_bytes long")
    assert {r.record_id for r in short.filter("record_type IN ('request', 'revisit')").collect()} == {
        "<urn:uuid:1>", "<urn:uuid:5>", "<urn:uuid:6>"}
    assert sum(r.payload_bytes or 0 for r in short.collect()) == sum(r[4] or 0 for r in foreign_rows())


@pytest.mark.parametrize("data", [
    gzip.compress(foreign(*FOREIGN[2][:4]))[:-20], foreign(*FOREIGN[2][:4])[:5000], b"something else", gzip.compress(b"else"),
])
def test_broken_files_are_errors(spark, tmp_path, data):
    (tmp_path / "x.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="the file ends within|no WARC record|Error -"):
        warc.read(spark, str(tmp_path), "record_id string").collect()


def test_urls_of_own_records_keep_their_spaces(spark, table, tmp_path):
    urls = [" http://a ", "", "\t", "<http://b>", "a: b \x85\x1c"]
    warc.archive(table([(k, u, "x") for k, u in enumerate(urls)], PAGES), str(tmp_path / "a"))
    assert {r.page_id: r.url for r in warc.read(spark, str(tmp_path / "a")).collect()} == dict(enumerate(urls))
