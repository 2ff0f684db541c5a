import zlib

import numpy as np
import pytest

from gradeflow.llm import packing
from gradeflow.llm.packing import INNER_PENALTY, WINDOW_PRICE, candidates, cuts, encoder, pack, padding


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_json_tokenizer(reference):
    encode, _ = encoder()
    for x in ["", " ", "a  b\n\n c\t\t", "  x ", "l'été　　x", "<|endoftext|>", "😀́ 12 ab'll", "\r\n\r\n", "a" * 3000, " " * 5000 + "x", "Don't  stop.\n \nNow!"]:
        assert encode(x) == reference(x), x


def cost(at, penalty, size, chosen):
    price = dict(zip(at.tolist(), penalty.tolist()))
    lengths = np.diff([0, *chosen])
    return int(padding(lengths, size).sum()) + sum(price[c] + WINDOW_PRICE for c in chosen)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    size = 64
    at = np.cumsum(rng.integers(1, 30, 60))
    penalty = rng.choice([0, 4, INNER_PENALTY], 60)
    powers = (1, 2, 4, 8, 16, 32, 64)
    best, position = [0] + [10**9] * 60, [0, *at.tolist()]
    for j in range(1, 61):
        for i in range(j):
            length = position[j] - position[i]
            if length <= size:
                pad = size - length if length not in powers else 0
                best[j] = min(best[j], best[i] + pad + int(penalty[j - 1]) + WINDOW_PRICE)
    chosen = cuts(at, penalty, size)
    got, price = 0, dict(zip(at.tolist(), penalty.tolist()))
    for a, b in zip([0, *chosen], chosen):
        got += (0 if b - a in powers else size - b + a) + price[b] + WINDOW_PRICE
    assert got == best[60] and chosen[-1] == at[-1]


def check(rows, docs, reference, size=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in docs.items():
        ids = np.array([*reference(t or ""), 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        own = 0 if at & (at - 1) == 0 else size - at
        assert at <= size and {r.padding for r in pieces} == {own}
        pad += own
    return pad / max(1, sum(r.length for r in rows))


def test_round_trip(docs_of, reference):
    texts = ["", None, "a.", "word " * 9000, "x" * 20_000, "One two. Three\nfour! " * 700, "same", "same"]
    docs = docs_of(texts, extra=True)
    assert check(pack(docs).collect(), dict(enumerate(texts)), reference) < 0.01
    got = pack(docs.coalesce(1), with_ids=True).collect()
    check(got, dict(enumerate(texts)), reference)
    assert all(len(r.ids) == r.length for r in got)
    assert pack(docs_of([])).collect() == []


def test_blocks_of_a_long_stream(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 10_000)
    rng = np.random.default_rng(0)
    ends = np.zeros(100, bool)
    ends[:4] = True
    packer = packing.Packer(2048, ends, 7 << 36)
    stream = {i: rng.integers(0, 100, int(n)).astype(np.uint32) for i, n in enumerate([*rng.integers(1, 3000, 200), 60_000, 1, 1])}
    pieces = [p for i, ids in stream.items() for p in packer.add(i, ids)] + list(packer.flush())
    filled = {}
    for doc_id, start, length, crc, total, sequence, offset, own in pieces:
        assert crc == zlib.crc32(own.astype("<u4").tobytes()) and length == len(own) and total == len(stream[doc_id])
        assert (own == stream[doc_id][start : start + length]).all() and offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
    assert sum(filled.values()) == sum(map(len, stream.values())) and max(filled.values()) <= 2048
    assert padding(np.array(list(filled.values())), 2048).sum() < 0.01 * sum(filled.values())


def test_blocks_give_the_cuts_of_the_whole_stream(monkeypatch):
    rng = np.random.default_rng(4)
    ends = np.zeros(100, bool)
    ends[:5] = True
    stream = [rng.integers(0, 100, int(n)).astype(np.uint32) for n in [*rng.integers(1, 400, 300), 5000, 1, 70]]
    found = {}
    for block in (300, 4_000, 10**9):
        monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
        packer = packing.Packer(256, ends, 0)
        found[block] = [p[:7] for i, ids in enumerate(stream) for p in packer.add(i, ids)] + [p[:7] for p in packer.flush()]
    assert found[300] == found[4_000] == found[10**9]


def test_cuts_fall_at_ends_of_sentences():
    size, bounds, ends = 64, np.array([40, 90, 400]), np.array([10, 20, 60, 100, 300])
    at, penalty = candidates(bounds, ends, size)
    assert set(at) - {*range(116, 300, 16), *range(316, 400, 16)} == {*bounds.tolist(), *ends.tolist()}
    assert all(penalty[np.isin(at, bounds)] == 0) and np.diff([0, *at]).max() <= size


def test_long_texts_are_encoded_in_pieces(reference):
    encode, _ = encoder()
    text = "It's  a long text, isn't it? 12 34\n\n x " * 50
    for piece in (1, 7, 100):
        assert packing.encoded(encode, text, piece).tolist() == [*reference(text), 1]


def test_repeated_and_null_ids(docs_of):
    got = pack(docs_of([(None, "a"), (3, "b"), (3, "b")])).collect()
    assert len(got) == 3 and all(r.start == 0 for r in got)


def test_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pack(docs).collect(), texts, reference) < 0.01


def test_added_tokens_as_the_json_tokenizer_has_them(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda x: default.encode(x, add_special_tokens=False).ids
    texts = ["a<|endoftext|>b", "<|endoftext|>", "One.  <|endoftext|> <|endoftext|>\n\nTwo", "plain  text."]
    assert 50256 in ids(texts[0])
    check(pack(docs_of(texts)).collect(), dict(enumerate(texts)), ids)
