"""Hierarchical multi-length packing.

Documents are tokenised and routed to context-size tiers (powers of two). Each document
gives off whole windows of the longest tier; what is left goes to the smallest tier that
holds it. Every tier is packed into windows of its own length, the gap of a window being
filled from shorter tiers, largest piece first, and only then by cutting a piece. So every
window is full but for one rest per task, which goes to shorter and shorter tiers until
less than the smallest tier remains. Windows of one tier form step groups of equal tokens.

Packing runs where the rows are read: there is no shuffle, so no key can be hot. A task
holds at most `hold_tokens` waiting tokens plus one Arrow batch.

Defined results: a null or empty text is one piece holding only the end id; a text of any
length is cut, never truncated; repeated rows are packed as often as they occur (their
pieces carry the same doc_id); an empty table gives no rows; a null doc_id is kept as null;
extra columns are ignored. Sequence ids are unique over the job: the task's partition
number in the high bits, a running number in the low ones. They depend on how the input is
split, and are the same again when a lost task is run again over the same split.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean
from .shingles import inverses, mix, powers

TIERS = (4096, 2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, sequence_tokens long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


CHUNK = 1 << 20
# The normaliser, splitting pattern and suffix of the tokenizer whose pieces are found here byte by byte.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
SUFFIX = "</w>"

SPACE, LETTER, DIGIT, MARK, END = range(5)
KINDS = np.full(256, MARK, dtype=np.uint8)
KINDS[[32, *range(9, 14)]] = SPACE
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[0] = END
#: The bytes of texts whose pieces, case and composition are certain: ASCII without control signs and apostrophes, and the letters of Latin-1.
PLAIN = bytes([*range(9, 14), *(c for c in range(32, 127) if c != 39), *range(128, 192), 0xC3])
ODD = (b"<|", "×".encode(), "÷".encode())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class PieceTokens:
    """Ids of the pieces that the tokenizer merges on their own, for whole batches of texts.

    Pieces are found and hashed (64 bits) over a chunk of bytes at once. A table with one slot
    for each value of the hash's top bits holds the ids of known pieces, so it is bounded, and
    a piece that shares a slot is only encoded again. Unknown pieces of a chunk are encoded in
    one call. Texts with other than plain bytes are encoded whole by the tokenizer, and so are
    all texts if it isn't of the kind whose pieces are known.
    """

    def __init__(self, path: str, slots: int = 20, most_ids: int = 8_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.shift, self.most_ids = Tokenizer.from_file(path), np.uint64(64 - slots), most_ids
        told = json.loads(self.tokenizer.to_str())
        model, steps = told["model"], (told["normalizer"] or {}).get("normalizers", [])
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known = model["type"] == "BPE" and model.get("end_of_word_suffix") == SUFFIX and [x["type"] for x in steps] == NORMAL and bool(splits) and splits[0].get("pattern") == {"Regex": SPLIT}
        if self.known:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        self.keys, self.starts, self.counts = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots, np.int64), np.zeros(1 << slots, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def add(self, keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes unknown pieces; where their ids start, and how many they are."""
        strings = [t.decode() for t in texts]
        joined = [" ".join(strings[i : i + 512]) for i in range(0, len(strings), 512)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(keys):
            each = [self.whole(t) for t in strings]
            ids, last = np.concatenate(each), np.cumsum([len(e) for e in each]) - 1
        counts = np.diff(last, prepend=-1)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        starts = self.used + last + 1 - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        slots = keys >> self.shift
        self.keys[slots], self.starts[slots], self.counts[slots] = keys, starts, counts  # of several in one slot the last stays
        return starts, counts

    def chunk(self, raw: bytes, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, each ended by a zero byte, and where each text ends among them."""
        data = np.frombuffer(raw, dtype=np.uint8)
        low = LOWER[data]
        upper = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper = upper[low[upper] < 0x9F]
        low[upper] += 32
        kinds = np.zeros(len(data) + 1, dtype=np.uint8)
        kinds[1:] = KINDS[data]
        turns = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT) | (kinds[1:] == END)
        edges = np.flatnonzero(turns)
        starts = edges[kinds[1:][edges] != SPACE]
        stops = np.append(edges, len(data))[1:][kinds[1:][edges] != SPACE]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=sums[1:])
        found = mix((sums[stops] - sums[starts]) * inverses(len(data))[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        ends = kinds[1:][starts] == END
        slots = found >> self.shift
        at, counts = self.starts[slots], self.counts[slots]
        missed = np.flatnonzero((self.keys[slots] != found) & ~ends)
        if len(missed):
            keys, first, of = np.unique(found[missed], return_index=True, return_inverse=True)
            text = low.tobytes()
            if self.used + len(text) > self.most_ids:  # the table is emptied while nothing of it is in use
                self.keys[:], self.used = 0, 0
                missed = np.flatnonzero(~ends)
                keys, first, of = np.unique(found[missed], return_index=True, return_inverse=True)
            new_at, new_counts = self.add(keys, [text[starts[i] : stops[i]] for i in missed[first]])
            at[missed], counts[missed] = new_at[of], new_counts[of]
        counts[ends] = 1
        upto = np.cumsum(counts)
        ids = self.ids[np.repeat(at - (upto - counts), counts) + np.arange(upto[-1])] if len(counts) else np.empty(0, np.uint32)
        last = upto[ends]
        ids[last - 1] = end_id
        return ids, last

    def encode(self, texts: Iterable[bytes | None], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text with the end id, in order; plain texts are taken together, about a chunk at once."""
        texts = [t or b"" for t in texts]
        at = 0
        while at < len(texts):
            if not self.plain(texts[at]):
                yield np.append(self.whole(texts[at].decode("utf-8", "replace")), np.uint32(end_id))
                at += 1
                continue
            stop, size = at, 0
            while stop < len(texts) and (not size or size + len(texts[stop]) < CHUNK) and self.plain(texts[stop]):
                size += len(texts[stop]) + 1
                stop += 1
            if size > 2 * CHUNK:
                yield self.parts(texts[at], end_id)
            else:
                ids, last = self.chunk(b"\0".join([*texts[at:stop], b""]), end_id)
                begin = 0
                for end in last.tolist():
                    yield ids[begin:end]
                    begin = end
            at = stop

    def plain(self, raw: bytes) -> bool:
        return self.known and not raw.translate(None, PLAIN) and not any(x in raw for x in ODD)

    def parts(self, raw: bytes, end_id: int) -> np.ndarray:
        """A very long plain text, cut between words; a word that is longer than a chunk is left to the tokenizer."""
        out, at = [], 0
        while at < len(raw):
            stop = raw.rfind(b" ", at, at + CHUNK) if at + CHUNK < len(raw) else len(raw)
            if stop <= at:
                stop = next((i for i in (raw.find(b" ", at + CHUNK),) if i >= 0), len(raw))
            out.append(self.chunk(raw[at:stop] + b"\0", end_id)[0][:-1] if stop - at <= 2 * CHUNK else self.whole(raw[at:stop].decode()))
            at = stop
        return np.concatenate([*out, np.array([end_id], np.uint32)])


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    """One table for all tasks that a worker runs."""
    return PieceTokens(path)


class TierPacker:
    """Packs the pieces of one task. A piece is (doc_id, its ids, start, length, tokens of the document); a waiting piece holds no ids but its own."""

    def __init__(self, tiers: Iterable[int], high: int, step_tokens: int):
        self.tiers = sorted(tiers, reverse=True)
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.high, self.step_tokens = high, step_tokens
        self.held = self.sequences = self.groups = 0
        self.filled = dict.fromkeys(self.tiers, 0)
        self.group = dict.fromkeys(self.tiers, -1)
        self.rows: list[tuple] = []

    def route(self, piece: tuple) -> None:
        tier = next(t for t in reversed(self.tiers) if t >= piece[3])
        self.waiting[tier].append(piece)
        self.held += piece[3]

    def add(self, doc_id, ids: np.ndarray) -> None:
        longest, n = self.tiers[0], len(ids)
        whole = n - n % longest
        for start in range(0, whole, longest):
            self.emit(longest, [(doc_id, ids[start : start + longest], start, longest, n)])
        if n > whole:
            self.route((doc_id, ids[whole:].copy(), whole, n - whole, n))

    def emit(self, tier: int, pieces: list) -> None:
        if not self.filled[tier] or self.filled[tier] + tier > self.step_tokens:
            self.group[tier], self.filled[tier], self.groups = self.groups, 0, self.groups + 1
        self.filled[tier] += tier
        at, total = 0, sum(p[3] for p in pieces)
        for doc_id, ids, start, n, tokens in pieces:
            self.rows.append((doc_id, start, n, zlib.crc32(ids), tokens, self.high | self.sequences, at, tier, self.high | self.group[tier], total))
            at += n
        self.sequences += 1

    @staticmethod
    def cut(piece: tuple, gap: int) -> tuple[tuple, tuple]:
        doc_id, ids, start, n, tokens = piece
        return (doc_id, ids[:gap], start, gap, tokens), (doc_id, ids[gap:], start + gap, n - gap, tokens)

    def take(self, tier: int, gap: int):
        """A piece for the gap of a window: from shorter tiers, longest first, whole if one fits; else a cut one."""
        below = [t for t in self.tiers if t <= tier and self.waiting[t]]
        for t in below:
            if self.waiting[t][-1][3] <= gap:
                piece = self.waiting[t].pop()
                self.held -= piece[3]
                return piece
        if not below:
            return None
        piece = self.waiting[below[-1]].pop()
        self.held -= piece[3]
        piece, left = self.cut(piece, gap)
        self.route(left)
        return piece

    def flush(self, last: bool) -> None:
        for tier in self.tiers:
            while self.waiting[tier]:
                pieces, gap = [self.waiting[tier].pop()], tier
                self.held -= pieces[0][3]
                gap -= pieces[0][3]
                while gap and (piece := self.take(tier, gap)):
                    pieces.append(piece)
                    gap -= piece[3]
                if not gap:
                    self.emit(tier, pieces)
                elif not last:
                    for piece in pieces:
                        self.route(piece)
                    return
                else:
                    self.rest(pieces)

    def rest(self, pieces: list) -> None:
        """What is too little for a window goes to the longest tier that it fills, and so on."""
        for tier in [*self.tiers, 0]:
            total = sum(p[3] for p in pieces)
            if not total or (tier and total < tier):
                continue
            if not tier:
                self.emit(self.tiers[0], pieces)
                return
            window, gap, left = [], tier, []
            for piece in pieces:
                if piece[3] <= gap:
                    window.append(piece)
                    gap -= piece[3]
                elif gap:
                    first, second = self.cut(piece, gap)
                    window.append(first)
                    left.append(second)
                    gap = 0
                else:
                    left.append(piece)
            self.emit(tier, window)
            pieces = left


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: Iterable[int] = TIERS, step_tokens: int = 32_768, hold_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece of a document: where it starts, the sequence and offset it went to, tier and step group."""
    tiers = tuple(tiers)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32() if n == "tier" else pa.int64() for n in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_tokens(tokenizer_path)
        packer = TierPacker(tiers, TaskContext.get().partitionId() << 40, step_tokens)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).cast(pa.binary()).to_pylist(), end_id), strict=True):
                packer.add(doc_id, ids)
                if packer.held > hold_tokens:
                    packer.flush(last=False)
                if len(packer.rows) >= 20_000:
                    yield batch(packer.rows)
                    packer.rows = []
        packer.flush(last=True)
        if packer.rows:
            yield batch(packer.rows)

    return docs.select("doc_id", "text").mapInArrow(lean(pack), SCHEMA)
