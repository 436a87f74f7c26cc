import glob
import gzip
import hashlib

import pytest

from tradewind.llm import warc as W
from tradewind.llm.queries import op10_warc

SCHEMA = "page_id bigint, url string, html string, target string, n string, key string, payload string"


def pages_of(spark, rows):
    return spark.createDataFrame([(p, u, h, "t", "n", "k", "p") for p, u, h in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    big, wide = "<p>" + "x" * 1200, "é" * 500  # 500 characters are 1000 bytes
    return [(5, "http://a/ b\r\nX: 1", big), (9, None, big), (2, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u", wide), (7, "u", wide),
            (8, "é", None), (8, "é", ""), (10, "u", "y" * 999), (11, "u", "y" * 999), (None, "u", big), (12, "u", "z" * 200_000),
            (13, "u", "q" * 2000), (13, "u", "q" * 2000), (1, "u", "q" * 2000), (14, "u", "a\r\n\r\nWARC/1.1\r\n\r\n")]


def plain(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        target = max(same) if len(data) >= 1000 and same else page
        revisit = target != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, rows, tmp_path):
    pages_of(spark, rows).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in op10_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_payloads_urls_and_rolled_files(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/out"
    manifest = W.write(pages_of(spark, rows), folder, roll_bytes=600, shard_bytes=2000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    files = sorted(glob.glob(f"{tmp_path}/out/*"))
    assert [f.rsplit("/", 1)[1] for f in files] == sorted(m.file for m in manifest)  # no temporary name is left
    for m in manifest:
        with open(f"{tmp_path}/out/{m.file}", "rb") as f:
            data = f.read()
        assert len(data) == m.bytes and hashlib.sha1(data).hexdigest() == m.sha1
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    back = W.read(spark, spark.createDataFrame(manifest, W.MANIFEST), folder).collect()
    html = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response" and r.page_id is not None)
    assert {r.url for r in back if r.page_id in (5, 9)} == {"http://a/%20b%0D%0AX:%201", "about:blank"}
    order = [r.page_id for m in sorted(manifest, key=lambda m: m.file)
             for r in W.read(spark, spark.createDataFrame([m], W.MANIFEST), folder).collect()]
    assert order == sorted(order, key=lambda p: (p is not None, p or 0))


def test_the_same_rows_give_the_same_bytes(spark, rows, tmp_path):
    pages = pages_of(spark, rows)
    one, two = (sorted(map(tuple, W.write(pages, f"file://{tmp_path}/{n}", shard_bytes=2000).collect())) for n in "ab")
    assert one == two


def test_many_rows_give_the_same_files_in_any_partitioning(spark, tmp_path):
    """Ids far apart and in clusters, sizes from nothing to 20 KB, copies; shards are even."""
    import random
    rng = random.Random(3)
    rows = []
    for i in range(20_000):
        page = i if i % 3 else 10**12 + i * 7 if i % 2 else -(10**15) + i
        rows.append((page, f"http://h{i % 50}/{i}", rng.choice("abcdef") * rng.randrange(0, 2000) if i % 40 else "z" * rng.choice([1500, 20_000])))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifests = [sorted(map(tuple, W.write(p, f"file://{tmp_path}/{n}", shard_bytes=1 << 20).collect()))
                 for n, p in enumerate((pages, pages.repartition(5), pages.orderBy("url")))]
    assert manifests[0] == manifests[1] == manifests[2] and sum(m[1] for m in manifests[0]) == len(rows)
    raw = {}
    for m in manifests[0]:
        with gzip.open(f"{tmp_path}/0/{m[0]}") as f:
            raw[m[0].split("-")[1]] = raw.get(m[0].split("-")[1], 0) + len(f.read())
    assert 15 <= len(raw) <= 40 and max(raw.values()) <= 2 * sum(raw.values()) / len(raw)
    back = W.read(spark, spark.createDataFrame(manifests[0], W.MANIFEST), f"file://{tmp_path}/0", with_payload=False)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect() if r.refers_to is None) == \
        sorted(p[:5] for p in plain_by_payload(rows) if p[4] is None) and back.count() == len(rows)


def plain_by_payload(rows):
    target = {}
    for page, _, html in rows:
        target[html] = max(page, target.get(html, page))
    out = []
    for page, _, html in rows:
        revisit = len(html) >= 1000 and target[html] != page
        out.append((page, len(html), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", target[html] if revisit else None))
    return out


def test_a_hot_page_id_fills_shards_of_its_own(spark, tmp_path):
    rows = [(7, f"u{i}", "x" * 1500 + str(i % 9)) for i in range(600)] + [(7, "same", "y" * 2000)] * 600 + [(i, "u", "x" * 1500 + "3") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    folder = f"file://{tmp_path}/out"
    manifest = W.write(pages, folder, shard_bytes=100_000)
    per_shard = {}
    for m in manifest.collect():
        per_shard[m.file.split("-")[1]] = per_shard.get(m.file.split("-")[1], 0) + m.records
    assert len(per_shard) >= 15 and max(per_shard.values()) < 300
    ids = set()
    for f in glob.glob(f"{tmp_path}/out/*.gz"):
        ids |= {line for line in gzip.open(f).read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")}
    assert len(ids) >= 1000 + 600  # no two records share an id, the copies of one row neither
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.read(spark, manifest, folder).drop("payload").collect() if r.page_id != 7)
    assert got == sorted((i, 1501, "response" if i == 399 else "revisit", None if i == 399 else 399) for i in range(400) if i != 7)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids(spark, tmp_path, kind):
    ids = ([f"http://example.com/{i % 300:05d}/{i}" for i in range(900)] + ["http://example.com/", "", "é"] if kind == "string" else list(range(-450, 450)))
    rows = [(i, "u", "abc" * (n % 500)) for n, i in enumerate([*ids, None])]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string").repartition(3)
    back = W.round_trip(pages, folder=f"file://{tmp_path}/out", shard_bytes=50_000)
    assert back.schema["page_id"].dataType.simpleString() == kind
    assert sorted((r.page_id, r.payload_bytes) for r in back.collect() if r.page_id is not None) == sorted((i, len(h)) for i, _, h in rows if i is not None)
    assert back.count() == len(rows)


def test_files_of_lost_attempts_are_swept(spark, rows, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "_part-00000-00000.warc.gz.77.tmp").write_bytes(b"half")
    (tmp_path / "out" / "part-00000-00000.warc.gz").write_bytes(b"of a lost attempt")
    manifest = W.write(pages_of(spark, rows), f"file://{tmp_path}/out")
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == sorted(m.file for m in manifest.collect())
    assert W.read(spark, manifest, f"file://{tmp_path}/out").count() == len(rows)


def test_damage_is_found(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/out"
    manifest = W.write(pages_of(spark, rows[:3]), folder)
    record = gzip.decompress(open(f"{tmp_path}/out/{manifest.first().file}", "rb").read())
    with pytest.raises(ValueError):
        W.parse(record[:record.index(b"\r\n\r\n\r\n\r\n")] if b"\r\n\r\n\r\n\r\n" in record else record[:-10])
    good = W.record("1", "u", b"body", None, W.DATE)
    assert W.parse(good)["payload"] == b"body"
    with pytest.raises(ValueError):
        W.parse(good.replace(b"body", b"bodY"))


def test_empty_table(spark):
    assert W.round_trip(pages_of(spark, [])).count() == 0
