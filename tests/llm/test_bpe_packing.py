import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docgate.llm import bpe
from docgate.llm.packing import cut, pack, pack_documents, patterns, slots
from tests.llm.helpers import SMALL, TEXTS, edge_docs, small_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lists(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_and_texts_are_those_of_the_library(library):
    rng = random.Random(1)
    bits = ["'s", "'re", "'", "  ", " ", "\n", "\t", "ab", "Ünï", "12", "²", "!", "<|endoftext|>", "é", "aaa", "'ll", "　", "<|", "😀", "don't", "'S", "\r\n", "\x1c", "中文", "\x00", "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [t or "" for t in TEXTS] + ["a" * 3000, " " * 300]
    own = bpe.Codec(PATH)
    ids, offsets = own.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert lists(ids, offsets) == want
    assert own.decode(ids, offsets) == [library.decode(x, skip_special_tokens=False) for x in want]
    assert own.encode([])[0].size == 0


def test_decoding_bytes_that_are_not_text(library):
    own = bpe.Codec(PATH)
    rows = [np.random.default_rng(i).integers(0, 50257, 30) for i in range(200)]
    offsets = np.arange(0, 30 * 201, 30)
    assert own.decode(np.concatenate(rows), offsets) == [library.decode(r.tolist(), skip_special_tokens=False) for r in rows]


def test_known_words_are_forgotten_without_effect(library):
    own = bpe.Codec(PATH)
    own.KEEP = 3
    for text in ("one two three four", "five six seven", "one two eight"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec_query_and_awkward_rows(spark, library):
    from docgate.llm.queries import op6_bpe

    texts = {r.doc_id: r.text or "" for r in small_docs(spark).collect()}
    rows = op6_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    docs = edge_docs(spark)
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(out) == docs.count() and all(r.decoded == (r.text or "") for r in out)
    assert bpe.encode(edge_docs(spark, empty=True), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, PATH).collect()] == ["", ""]


@pytest.mark.parametrize("seed", range(30))
def test_patterns_hold_every_piece_once_and_no_two_sequences_fit_in_one(seed):
    rng = random.Random(seed)
    histogram = Counter(min(32, 1 + int(rng.expovariate(0.1))) if seed % 2 else rng.randint(1, 32) for _ in range(rng.randint(1, 3000)))
    found = patterns(dict(histogram), 32)
    placed = Counter()
    for pattern, count in found:
        assert count > 0 and sum(pattern) <= 32
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    fills = sorted(sum(pattern) for pattern, count in found for _ in range(min(count, 2)))
    assert len(fills) < 2 or fills[0] + fills[1] > 32
    length, rank, *_ = slots(found)
    assert all(rank[length == k].min() == 0 for k in histogram)


def whole(rows, size):
    """Sequences are gapless from 0 and hold at most size."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return by


def test_packing_query(spark, library):
    from docgate.llm.queries import op5_packing

    rows = op5_packing(spark, SMALL).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in small_docs(spark).collect()}
    by = whole(rows, 1024)
    assert sorted(by) == list(range(len(by)))
    seen = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: len(x) for d, x in ids.items()}
    assert all(len({s for s, _ in p}) == len(p) for p in seen.values())
    assert sum(map(len, ids.values())) / (1024 * len(by)) > 0.97


def test_packing_awkward_rows(spark):
    docs = edge_docs(spark)
    rows = pack_documents(docs, PATH, size=16, end=0).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    whole(rows, 16)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, Counter())[r.start] += 1
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert by_doc[0] == {0: 1} and by_doc[3 * 8][0] == 2  # a null text is its end alone; the repeated row stays
    assert pack_documents(edge_docs(spark, empty=True), PATH).count() == 0
    long = spark.createDataFrame([(1, 0, 17)], "doc_id long, start long, length long")
    with pytest.raises(ValueError, match="length 17"):
        pack(long, size=16)
    many = spark.range(500).selectExpr("id as doc_id", "0L as start", "id % 7 + 1 as length", "'x' as part", "'y' as rank")
    for ranked in (3, 1000):
        packed = pack(many, size=8, ranked=ranked)
        assert packed.columns == ["doc_id", "start", "length", "part", "rank", "sequence_id", "offset"]
        rows = packed.collect()
        assert len({(r.sequence_id, r.offset) for r in rows}) == len({r.doc_id for r in rows}) == 500
        whole(rows, 8)
    assert cut(docs, PATH, with_ids=False).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
