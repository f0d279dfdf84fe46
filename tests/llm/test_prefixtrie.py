import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sparkgraft.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie of prefixes, node by node."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, saved, leaves = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS key", "3 AS block")
    found = prefixtrie.prefix_trie(spark, df, **more)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"block_turns": 3, "shard_turns": 40}, {"block_turns": 1, "shard_turns": 5, "hot_parents": 1}], ids=["whole", "blocks and shards", "blocks of one turn"])
def test_against_the_plain_trie(spark, more):
    pick = random.Random(3)
    rows = []
    for c in [*range(-105, 130), 200, 399, 450, 451]:
        for t in range(pick.randrange(0, 9)):
            rows.append((c, None if pick.random() < 0.05 else t, pick.choice(["user", "user", "assistant", None]), pick.choice(["a", "b", "é" * 9, "", None])))
    rows += [(500, 0, "user", "x")] + [(c, 0, "user", "x") for c in range(501, 560)] + [(None, 1, "user", "lost")] + [(600, 1, "r", "t")] * 3
    rows += [(700, t, "user", f"turn {t % 7}") for t in range(200)] + [(701, t, "user", f"turn {t % 7}") for t in range(200)]
    assert run(spark, rows, **more) == plain(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(300, t, "user", str(t % 5)) for t in range(4000)] + [(c, 0, "user", "0") for c in range(301, 330)]
    assert run(spark, rows, block_turns=64) == plain(rows)


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
    assert run(spark, [(1, 0, None, None)]) == plain([(1, 0, None, None)])


def test_end_lists_in_pieces(spark):
    ended = spark.range(1000).selectExpr("CAST('n' AS BINARY) AS node", "id AS conv_id").union(spark.range(3).selectExpr("CAST('m' AS BINARY)", "id"))
    got = {bytes(r.node): r.ends_sha256 for r in prefixtrie.hashed_ends(ended, piece=7).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest() for k, n in ((b"n", 1000), (b"m", 3))}


def test_index_meets_bitsets():
    shard = prefixtrie.Shard(8)
    for conv, keys in ((1, [b"a", b"b"]), (2, [b"a", b"c"]), (3, [b"a"])):
        shard.add(conv, 0, prefixtrie.ROOT, None, keys, [1] * len(keys), True, 0, 0, 0)
    assert shard.index[0, 0, b"a"] == 0b111 and shard.index[0, 1, b"b"] == 0b001
    rows = [r for r in shard.walk() if len(r) > 2]
    assert sorted((r[2], r[3], r[4]) for r in rows) == [(0, 1, 3), (1, 1, 3), (2, 1, 1), (2, 2, 1)]
    assert sorted(ids for x in shard.walk() if len(x) == 2 for ids in [x[1]]) == [[1], [2], [3]]
