
from sparkgraft.llm import warc
from sparkgraft.llm.common import Scratch

LONG = "<p>" + "é" * 60 + "\r\n\r\n</p>"


def test_round_trip_is_exact(spark):
    rows = [(1, "u", LONG), (2, None, LONG), (3, "u", None), (4, "u", ""), (5, "x y", "short"), (6, "u", "short"), (None, "u", LONG), (1, "again", LONG), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", warc.F.lit("clash"))
    scratch = Scratch(spark, "test")
    manifest = scratch.cut(warc.write_archives(spark, df, scratch.path("b"), frame_bytes=1000), "m")
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())
    n = len(LONG.encode())
    assert found == [(0, n, "response", None), (1, n, "response", None), (1, n, "response", None), (2, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 300_000, "response", None)]
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_frames_are_independent_and_whole_bundles_decode(spark):
    import zstandard

    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "test")
    rows = warc.write_archives(spark, df, scratch.path("b"), frame_bytes=2000, bundle_bytes=900).collect()
    assert len({r.bundle for r in rows}) > 1
    seen = []
    for bundle in {r.bundle for r in rows}:
        fs, place = warc.file_system(bundle)
        with fs.open_input_file(place) as f:
            table = warc.seek_table(f)
            f.seek(0)
            whole = f.read()
        plain = b"".join(zstandard.ZstdDecompressor().decompress(whole[a : a + c]) for a, c, _ in table)
        frames = {r.frame: r.records for r in rows if r.bundle == bundle}
        assert sorted(frames) == list(range(len(table)))
        for frame, records in frames.items():
            data = zstandard.ZstdDecompressor().decompress(whole[table[frame][0] : table[frame][0] + table[frame][1]])
            for r in records:
                record = data[r.offset : r.offset + r.length]
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
                page, length, _, kind, _, _ = warc.read_record(record)
                assert r.record_id == warc.urn(page) and kind == "response" and f"page {page} ".encode() * 50 in record
                seen.append(page)
    assert sorted(seen) == list(range(40))


def test_single_records_are_sought_by_id(spark):
    df = spark.createDataFrame([(i % 30, f"u{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "test")
    manifest = scratch.cut(warc.write_archives(spark, df, scratch.path("b"), frame_bytes=2000), "m")
    asked = spark.createDataFrame([(warc.urn(i),) for i in (3, 15, 15, 99)] + [(None,)], "record_id string")
    assert sorted((r.page_id, r.url) for r in warc.fetch(manifest, asked).collect()) == [(3, "u3"), (3, "u33"), (15, "u15")]
    assert warc.fetch(manifest, asked.limit(0)).count() == 0


def test_damage_is_noticed():
    record = warc.write_record(1, "u", b"abc", warc.hashlib.sha256(b"abd").hexdigest(), None, "1970-01-01T00:00:00Z")
    try:
        warc.read_record(record)
    except ValueError:
        return
    raise AssertionError


def test_a_folder_without_a_scheme_is_qualified(spark, tmp_path):
    """As Spark's writers, bundles go to the default file system; columns of clashing names and an empty table are no matter."""
    rows = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "1 AS salt", "2 AS payload", "3 AS first_id")
    manifest = warc.write_archives(spark, rows, str(tmp_path / "b")).collect()
    assert manifest and all(r.bundle.startswith("file:/") for r in manifest)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(spark, rows).collect())
    assert got == [(0, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.round_trip(spark, rows.limit(0)).count() == 0
