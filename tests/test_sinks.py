import os
import random

from sparkgraft.operators.fingerprint import differing_rows, fingerprint, ordered_digest
from sparkgraft.sources.sink import write_ordered
from sparkgraft.sources.tree import list_folders, list_tree, read_tree


def test_bytes_and_digest_do_not_depend_on_partitions(spark, tmp_path):
    pick = random.Random(2)
    rows = [(pick.choice("abc"), pick.randrange(9), pick.choice(["x", None, "é"])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, line string")
    seen = set()
    for parts in (1, 7, 64):
        folder = tmp_path / str(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        n, digest = write_ordered(df.repartition(parts), ["k", "n"], str(folder)).first()
        seen.add((n, digest, b"".join((folder / f).read_bytes() for f in sorted(os.listdir(folder)) if f.startswith("part-"))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    (found,) = seen
    assert found[0] == 500 and found[2].count(b"\n") == 500
    assert ordered_digest(df.where("n < 8"), ["k", "n"]).first().digest != found[1]


def test_a_sequence_in_another_order_has_another_digest(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert ordered_digest(df, ["a"]).first() != ordered_digest(df, ["b"]).first()
    assert ordered_digest(df.limit(0), ["a"]).first().n == 0


def test_differing_rows(spark):
    rows = [(i, f"v{i % 7}" if i % 5 else None) for i in range(2000)] + [(1, "v1")] * 3
    left = spark.createDataFrame(rows, "k int, v string")
    right = spark.createDataFrame([r for r in rows if r[0] != 77] + [(77, "other"), (1, "v1")], "k int, v string")
    assert fingerprint(left).first() == fingerprint(left.repartition(5)).first() != fingerprint(right).first()
    assert sorted(map(tuple, differing_rows(left, right, few=10).collect())) == [("left", 77, "v0"), ("right", 1, "v1"), ("right", 77, "other")]
    assert differing_rows(left, left.repartition(3)).count() == 0


def test_listing_equals_a_plain_walk(spark, tmp_path):
    for path in ("a/b/c/d.rs", "a/b/e.py", "a/.git/no.rs", "target/no.rs", "f.ts", "g.txt", "a/node_modules/x.ts", "h i/ü.pyi"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.symlink(tmp_path / "f.ts", tmp_path / "link.ts")
    want, _ = list_tree(str(tmp_path))
    listed = list_folders(spark, str(tmp_path)).collect()
    assert sorted(r.path.removeprefix("file:") for r in listed) == want and {r.kind for r in listed} == {"file"}
    files, lost = read_tree(spark, f"file://{tmp_path}", "o", "r")
    assert {r.path for r in files.collect()} == {p.removeprefix(f"{tmp_path}/") for p in want} and lost.count() == 0
    gone = list_folders(spark, str(tmp_path / "nowhere")).collect()
    assert [(r.path.endswith("/nowhere"), r.kind) for r in gone] == [(True, "unreadable")]
