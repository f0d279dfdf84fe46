import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkgraft.llm import packing
from sparkgraft.llm.queries import op1_packing, tokenizer_path

PLAIN_TOKENIZER = Tokenizer.from_file(tokenizer_path())
SF = "/root/testdata/sf0.001"


def verify(rows, texts):
    """Every id in one piece, checksums right, offsets gapless, padding small."""
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, x in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at == pieces[0].sequence_tokens
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, len(by_seq)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    padding, n = verify(op1_packing(spark, SF).collect(), texts)
    assert padding <= 4096 * spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions()


def test_edges(spark):
    long = "Alpha béta <|endoftext|> x’s don't  \t 12 34\n\x1c" * 2500
    texts = {1: None, 2: "", 3: long, 4: "a", 5: "ΑΣ ΟΔΟΣ é ﬁ", 6: " \n "}
    df = spark.createDataFrame([(i, x, "z", 1) for i, x in texts.items()], "doc_id long, text string, tier string, start int").coalesce(1)
    verify(packing.pack_documents(df, tokenizer_path(), hold_tokens=5000).collect(), texts)
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0
    twice = packing.pack_documents(df.union(df).coalesce(1), tokenizer_path()).collect()
    assert sum(r.length for r in twice if r.doc_id == 4) == 4


@pytest.mark.parametrize("seed", range(5))
def test_groups_are_balanced_and_windows_full(seed):
    rng = np.random.default_rng(seed)
    packer = packing.TierPacker(packing.TIERS, 0, 8192)
    for i in range(400):
        packer.add(i, np.zeros(int(rng.lognormal(5, 1.5)) + 1, dtype="<u4"))
        if packer.held > 20_000:
            packer.flush(last=False)
    packer.flush(last=True)
    sequences = {r[5]: (r[7], r[8], r[9]) for r in packer.rows}
    assert sum(total != tier for tier, _, total in sequences.values()) <= 1
    groups = defaultdict(int)
    for tier, group, _ in sequences.values():
        groups[tier, group] += tier
    per_tier = defaultdict(list)
    for (tier, _), n in groups.items():
        per_tier[tier].append(n)
    for sizes in per_tier.values():
        assert sum(n != 8192 for n in sizes) <= 1 and max(sizes) <= 8192


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("'srtvemdl Σς_ﬁ٣ÉÞ×÷\u0301<|endoftx>")), max_size=60), max_size=5))
def test_ids_are_the_tokenizers(texts):
    want = [[*PLAIN_TOKENIZER.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got = packing.piece_tokens(tokenizer_path()).encode([t.encode() for t in texts], 2)
    assert [ids.tolist() for ids in got] == want


def test_a_small_table_and_a_small_chunk_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    tokens = packing.PieceTokens(tokenizer_path(), slots=4, most_ids=2000)
    texts = [" ".join(f"w{i % (n + 1)}-É{i % 7} _.{i}" for i in range(n * 9)) for n in (0, 1, 3, 90, 2, 30)] + ["x" * 5000, "x" * 900 + " y" * 900, "a don't"]
    got = tokens.encode([t.encode() for t in texts], 2)
    assert [ids.tolist() for ids in got] == [[*PLAIN_TOKENIZER.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(tokens.keys) == 16 and tokens.used <= 2000


def test_another_tokenizer_is_used_as_it_is():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Plain words, 12 Of Them\nand more"
    assert next(packing.PieceTokens(path).encode([text.encode()], 7)).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 7]


def test_waiting_pieces_hold_their_own_ids_only():
    packer = packing.TierPacker(packing.TIERS, 0, 8192)
    for i in range(50):
        packer.add(i, np.arange(20_000, dtype=np.uint32))
    waiting = [p for tier in packer.waiting.values() for p in tier]
    assert len(waiting) == 50 and all(p[1].base is None and len(p[1]) == p[3] for p in waiting)
