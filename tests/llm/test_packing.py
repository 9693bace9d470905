import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deltaloom.llm import packing as P

TEXTS = [
    "Hello world, it's 3 o'clock.",
    "",
    None,
    " lead and trail ",
    "two  spaces\n\nand\ttabs \n x",
    "a <|endoftext|> b",
    "naïve café über élan",
    "word " * 5000,
    "x" * 9000,
    "line\nline\n line",
    "Hello world, it's 3 o'clock.",
]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash"), (None, "n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    return rows, P.pack_documents(docs).collect()


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= P.LIMIT
    return len(by)


def test_ids_and_cuts(packed):
    rows, out = packed
    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(P.cut(len(ids), P.LIMIT)):
            want.append((i, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert Counter(got) == Counter(want)
    check(out)


def test_encoder_equals_tokenizer_on_odd_text():
    own = P.Encoder(public_tokenizers.path(P.TOKENIZER), public_tokenizers.path(P.RANKS))
    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    rng = random.Random(1)
    pools = ["abc dE's 'll\n\t  ", "éüñßÇ ½²³ʼ", "0123456789 ٣५Ⅷ", "中文かナ ", "😀👍🏽\u200d\ufe0f", "\x00\x7f\x85\xa0\u2003\u3000 ", "\u0301ä", ".,!?'#$%"]
    for _ in range(1500):
        pool = "".join(rng.sample(pools, rng.randint(1, 4))) + " " * rng.randint(0, 5)
        text = "".join(
            rng.choice(pool) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)]))
            for _ in range(rng.randint(0, 40))
        )
        ids = tok.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_matches_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 50, 2048])
    counts = Counter(
        min(limit, max(1, int(rng.expovariate(3 / limit)))) for _ in range(rng.choice([5, 300, 3000]))
    )
    runs = P.plan_best_fit(counts, limit)
    used, placed = Counter(), Counter()
    spots = defaultdict(list)
    for length, rank, n, each, seq, off in runs:
        assert rank == placed[length]
        placed[length] += n
        for k in range(n):
            spots[seq + k // each].append((off + k % each * length, length))
    assert placed == counts
    for s, spans in spots.items():
        at = 0
        for off, length in sorted(spans):
            assert off == at
            at += length
        used[s] = at
        assert at <= limit
    free = []  # best-fit decreasing, one item at a time
    for length in sorted(counts.elements(), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(limit - length)
    assert len(spots) == len(free)


def test_hot_length_is_salted(spark, monkeypatch):
    monkeypatch.setattr(P, "PER_SALT", 7)
    rows = [(i, 0, 0, 3 if i % 3 else 5, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = P.place(df, 16).collect()
    assert len(out) == 200
    monkeypatch.setattr(P, "LIMIT", 16)
    # 67 fives, three to a sequence: 22 full ones, one with room for three of the 133 threes;
    # the other 130 go five to a sequence
    assert check(out) == 23 + 26


def test_memory_of_the_encoder_is_bounded():
    import public_tokenizers

    path, ranks = public_tokenizers.path(P.TOKENIZER), public_tokenizers.path(P.RANKS)
    small, large = P.Encoder(path, ranks, remember=200_000), P.Encoder(path, ranks)
    text = " ".join(f"w{i}x{'y' * (i % 90)}" for i in range(20_000))
    assert small.ids(text) == large.ids(text)
    assert small.memory.held <= 200_000 and len(small.memory) < 1_000
    assert all(len(part) <= P.LONG_PART for part in large.memory)


def test_ties_and_repeated_rows_fill_every_slot_once(spark):
    rows = [(1, "same text here")] * 700 + [(2, "same text here")] * 3 + [(None, "same text here")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = P.pack_documents(df).collect()
    assert len(got) == len(rows)
    slots = {(r.sequence_id, r.offset) for r in got}
    length = got[0].length
    assert len(slots) == len(rows) and {o % length for _, o in slots} == {0}
    assert len({s for s, _ in slots}) == -(-len(rows) // (P.LIMIT // length))


def test_every_document_of_the_tables_has_the_tokenizers_ids():
    import os
    import zlib

    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    whole = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    own = P.Encoder(public_tokenizers.path(P.TOKENIZER), public_tokenizers.path(P.RANKS))
    for text in pq.read_table(path).column("text").to_pylist():
        want = P.array("I", whole.encode(text or "", add_special_tokens=False).ids).tobytes()
        assert zlib.crc32(own.ids(text or "")) == zlib.crc32(want)
