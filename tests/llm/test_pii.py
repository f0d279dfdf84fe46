import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgraft.llm import pii
from sparkgraft.llm.queries import op3_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def base(text, finder=pii.Finder()):
    return [f"{k}:{s}:{e}" for s, k, e in finder.spans(text) if k in pii.BASE_KINDS]


PARTS = ["a.b@c.d", "@", "x@y", ".com", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", ".", "-", " ", "  ", "9", "0", "é", "(", ")", "12.34", "\n", "4539578763621486", "a", "%", "٣", "https://x.y/z", "0001.2.3.4"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_are_the_patterns(text):
    assert base(text) == brute(text)


def test_long_random_text():
    r = random.Random(1)
    text = "".join(r.choice(PARTS) for _ in range(20_000))
    assert base(text) == brute(text)
    assert base("1" * 200_000) == [] and base("a" * 200_000 + "@b.c") == ["email:0:200004"]


def test_added_spans():
    text = "see https://a.example/x?y=1. IBAN DE89 3704 0044 0532 0130 00, account no. 12345678 password=b7db7aa4 token = \"1beb58aa\""
    kinds = [(k, text[s:e]) for s, k, e in pii.Finder().spans(text)]
    assert ("url", "https://a.example/x?y=1") in kinds and ("iban", "DE89 3704 0044 0532 0130 00") in kinds
    assert ("account", "12345678") in kinds and ("secret", "b7db7aa4") in kinds and ("secret", "1beb58aa") in kinds


def test_spans_are_not_cut_and_cues_are_words():
    def found(text):
        return [(k, text[s:e]) for s, k, e in pii.Finder().spans(text)]

    long = "a1" + "Bc9-_." * 200 + "z"
    assert found(f"TOKEN={long} x") == [("secret", long)]
    assert found("PassWord: hunter2hunter2") == [("secret", "hunter2hunter2")]
    assert found("token2024xyz and secretary1234567 tokens 1234567") == []
    assert found("my_api_key = abc123def") == [("secret", "abc123def")]
    assert found("averylongschemename-with+more.parts://host/x") == [("url", "averylongschemename-with+more.parts://host/x")]
    assert found("pay DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, not DE88370400440532013000") == [("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found("IBAN: BR1500000000000010932840814P2 end")[-1] == ("iban", "BR1500000000000010932840814P2")
    assert found("İİİ token: abc123def")[0] == ("secret", "abc123def")


@pytest.mark.parametrize(
    "text",
    ["1.2.3." + "0" * 5000 + "1", "1.2.3." + "9" * 900_000, "://" * 330_000, "a://" * 250_000, "token" * 200_000, "token " * 160_000, "secret=" * 140_000, "token=" + "a" * 1_000_000, "iban " * 200_000, "DE89" * 250_000, "AB12 " * 200_000, "+1" * 500_000, "a@" * 500_000, "1 " * 500_000, "a.b" * 330_000 + "@" * 9000],
    ids=range(15),
)
def test_hostile_texts_take_linear_time(text):
    finder, began = pii.Finder(), time.process_time()
    finder.spans(text)
    assert time.process_time() - began < 8


def test_zeros_before_a_part():
    assert base("1.2.3." + "0" * 5000 + "1") == ["ip:0:5007"] and base("1.2.3." + "0" * 5000 + "256") == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_pii(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS] == want


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "q"), (None, "a@b.c", "q"), (2, "", "q"), (2, "", "q")], "doc_id long, text string, spans string")
    rows = pii.find_pii(df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_email, r.base_sha256 == empty) for r in rows) == [(0, 1, False), (1, 0, True), (2, 0, True), (2, 0, True)]
    assert pii.find_pii(df.limit(0)).count() == 0
