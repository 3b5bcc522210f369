import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_store, tokens
from tests.llm.conftest import rows_of

ODD = ["", " ", "  a", "a  b", "a \n b", "it's  l'an\t\tx ", "é ́a 12 3", "<|endoftext|> a", "a\x1cb \x1c c", "İI ΣΑΣ", "a\n\n b c\n d", "日本 語 　 x", "hello   world  \n\n  foo"]


def whole_ids(name, texts):
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piecewise_ids_equal_whole_ids(name, keep_space):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "́", ".", "!", "\u00a0", "\x1f", "İ", "Word", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    assert tokens.PieceEncoder(name, keep_space).encode(texts) == whole_ids(name, texts)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_file_round_trip(kind):
    rng = np.random.default_rng(2)
    docs = [(i if i % 7 else None, rng.integers(0, 1 << 17, n).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 10, 999, 1000, 2500, 3, 0])]
    out = io.BytesIO()
    writer = token_store.TokenFile(out, kind, block=1000)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    out.seek(0)
    assert [(d, ids.tobytes()) for d, ids in token_store.TokenReader(out).documents()] == docs


def test_store_matches_whole_tokenization(odd, odd_rows, clashing, empty, tmp_path):
    found = token_store.read_tokens(token_store.write_tokens(odd, f"file://{tmp_path}/a", 3)).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = [x + bytes(4) for x in whole_ids(token_store.VOCABULARY, [r[1] or "" for r in order])]
    start = 0
    for row, (doc, *_), data in zip(found, order, ids, strict=True):
        assert tuple(row) == (doc, start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    assert token_store.read_tokens(token_store.write_tokens(clashing, f"file://{tmp_path}/b", 2)).count() == len(odd_rows)
    assert token_store.read_tokens(token_store.write_tokens(empty, f"file://{tmp_path}/c", 2)).count() == 0


def check_plan(counts, capacity, groups):
    entries, n = packing.plan_packing(counts, capacity, groups)
    places, seen = {}, {}
    for length, rank, first, count, offset in entries:
        assert seen.get(length, 0) == rank
        seen[length] = rank + count
        for k in range(count):
            places.setdefault(first + k, []).append((offset, length))
    assert seen == {k: v for k, v in counts.items() if v}
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == n
    return n


def test_plans_are_valid_and_tight():
    rng = random.Random(3)
    for _ in range(20):
        capacity = rng.choice([10, 100, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        n = check_plan(counts, capacity, rng.choice([1, 4, 64]))
        assert n >= -(-sum(k * v for k, v in counts.items()) // capacity)
    counts = {k: 20 for k in range(1, 2049)}
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert check_plan(counts, 2048, packing.GROUPS) <= 1.01 * least


def test_configurations_are_optimised_together():
    for n in (1, 20, 300):
        assert check_plan({1034: 6 * n, 532: 6 * n, 522: 6 * n, 492: 12 * n}, 2048, packing.GROUPS) == 9 * n
    rng = random.Random(1)
    for parts, kinds in ((3, 5), (4, 5), (3, 20)):
        counts = {}
        for _ in range(kinds):
            cuts = sorted(rng.sample(range(4, 77), parts - 1))
            for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
                size = (b - a) * 25 + (48 if b == 80 else 0)
                counts[size] = counts.get(size, 0) + 100
        assert check_plan(counts, 2048, packing.GROUPS) <= 1.01 * 100 * kinds
    for _ in range(10):
        counts = {rng.randint(100, 2048): rng.randint(1, 80) for _ in range(40)}
        greedy = min(packing.plan_with(counts, 2048, packing.GROUPS, s, False)[1] for s in packing.SMALL)
        assert check_plan(counts, 2048, packing.GROUPS) <= greedy


def test_pack_documents(odd, odd_rows, clashing, empty):
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    found = packing.pack_documents(clashing, capacity=64)
    expected = []
    for row, ids in zip(odd_rows, whole_ids(packing.VOCABULARY, [r[1] or "" for r in odd_rows]), strict=True):
        ids += bytes(4)
        expected += [(row[0], k, 64 * k, len(ids[a : a + 256]) // 4, zlib.crc32(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    assert rows_of(found, *names) == sorted(expected, key=str)
    by_sequence = {}
    for r in found.collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in by_sequence.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= 1.05 * -(-sum(r[3] for r in expected) // 64) + 1
    assert packing.pack_documents(empty).count() == 0
