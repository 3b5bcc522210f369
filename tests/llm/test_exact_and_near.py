import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, ngram_join
from tests.llm.conftest import DOC_SCHEMA, rows_of


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, width in ((1, 10), (5, 1 << 20), (4000, 1 << 40), (3000, 5000)):
        values = np.unique(rng.integers(0, width, n).astype(np.uint64))
        for parameter in (0, exact_dedup.rice_parameter(len(values), width)):
            if width >> parameter < 1 << 22:
                assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, parameter)) == values).all()


def brute_dedup(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        flags = [i == keep for i in ids]
        first = flags.index(True)
        for k, i in enumerate(ids):
            out.append((i, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(odd, odd_rows, clashing, empty):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    expected = brute_dedup(odd_rows)
    assert rows_of(exact_dedup.deduplicated(odd), *names) == expected
    assert rows_of(exact_dedup.deduplicated(clashing), *names) == expected
    assert exact_dedup.deduplicated(empty).count() == 0


def test_drop_copies_keeps_one_of_each(odd, odd_rows, clashing, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(r[1]) for r in odd_rows})
    own = exact_dedup.drop_copies(clashing.withColumn("text_sha256", F.lit("other")).withColumn("copy_number", F.lit("other")))
    assert own.columns == [*clashing.columns, "text_sha256", "copy_number"] and own.count() == kept.count()
    names = own.columns[5:]
    assert own.select(*names).distinct().collect() == [("other",) * len(names)]
    assert exact_dedup.drop_copies(empty).count() == 0


def brute_near(rows, n=5):
    sets = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (di, a) in enumerate(sets):
        for j in range(i):
            dj, b = sets[j]
            if (di is not None and di == dj) or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                x, y = find(i), find(j)
                parent[x] = y
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def near_rows(seed, n, bases, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.randint(30, 90))] for _ in range(bases)]
    common = [rng.choice(words) for _ in range(25)]
    rows = []
    for i in range(n):
        t = list(texts[min(int(rng.expovariate(1.0)), bases - 1)])
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t = common + t
        rows.append((i, " ".join(t), "en", "a", 1))
    return rows


def test_words_that_agree_in_polynomials():
    first, other = "a", "b"
    for _ in range(10):  # Thue-Morse words of 1,024 letters
        first, other = first + other, other + first
    plain = ["x y z", "u v"]
    hashes = {int(ngram_join.hashed_words(w.encode())[0][0]) for w in (first, other, first.upper(), "ab" * 512)}
    assert len(hashes) == 3
    a, b, c = ngram_join.shingle_sets([f"{plain[0]} {w} {plain[1]}".encode() for w in (first, other, first.upper())])
    assert len(a) == 2 and not set(a.tolist()) & set(b.tolist()) and (a == c).all()
    words = [bytes([97 + i % 26]) * n for i, n in enumerate(range(1, 60))]
    assert len(set(ngram_join.hashed_words(b" ".join(words))[0].tolist())) == len(words)


def test_long_texts_by_pieces(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60_000)]
    base = [rng.choice(words) for _ in range(70_000)]
    near = list(base)
    for _ in range(900):
        near[rng.randrange(len(near))] = "changed"
    rows = [(1, " ".join(base), "en", "a", 1), (2, "\n".join(near), "en", "a", 1), (3, " ".join(base[:40_000]), "en", "a", 1), (4, "x" * 300_000 + " tail", "en", "a", 1), (5, "X" * 300_000 + "  tail", "en", "a", 1)]
    assert all(len(r[1]) > ngram_join.PIECE_BYTES for r in rows[:2])
    assert ngram_join.shingle_sets([rows[0][1].encode()])[0].tolist() == next(iter(ngram_join.of_words(np.concatenate([ngram_join.hashed_words(w.encode())[0] for w in base]), np.array([0, len(base)]), 5))).tolist()
    found = ngram_join.similarity_classes(spark.createDataFrame(rows, DOC_SCHEMA))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute_near(rows)


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 4)])
def test_near_copies_match_brute_force(spark, seed, edits):
    rows = near_rows(seed, 150, 6, edits)
    found = ngram_join.similarity_classes(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute_near(rows)


def test_near_edge_cases(odd, odd_rows, clashing, empty):
    names = ("doc_id", "n_shingles", "component_id")
    expected = [r for r in brute_near(odd_rows)]
    assert rows_of(ngram_join.similarity_classes(clashing), *names) == expected
    assert ngram_join.similarity_classes(empty).count() == 0
    kept = ngram_join.drop_near(odd)
    assert kept.columns == odd.columns
    gone = {d for d, _, c in expected if d is not None and d != c}
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in odd_rows} - gone


def test_shingles_do_not_depend_on_batches():
    texts = [b"", b" ", b"A b", b"a b\tc\nd  e f", "É a b c d e".encode(), b"x y " * 50]
    together = ngram_join.shingle_sets(texts)
    for text, found in zip(texts, together, strict=True):
        assert (ngram_join.shingle_sets([text])[0] == found).all()
    assert len(together[4]) == 2 and len(together[5]) == 2


def crowd_rows():
    """Families whose documents have one prefix and one size but many different sets."""
    rng = random.Random(9)
    line = lambda name, n: [f"{name}{i}" for i in range(n)]
    blocks = [line(f"block{k}x", 8) + line("sep", 4) for k in range(12)]
    texts = []
    for family in ("rare", "odd"):
        for _ in range(30):
            chosen = sorted(rng.sample(range(12), 5))
            texts.append(line(family, 64) + line("sep", 4) + sum((blocks[k] for k in chosen), []))
    texts += [line(f"other{i}x", 3) + line("sep", 4) + sum(rng.sample(blocks, 12), []) for i in range(80)]
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]


def test_crowded_groups_and_the_last_round(spark, monkeypatch):
    rows = crowd_rows()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    scanned = ngram_join.scanned(docs, ngram_join.sketch(docs, 5), 5, 80, 100, 8).filter("owner is null")
    assert scanned.groupBy("grp").agg(F.countDistinct("sig").alias("k")).agg(F.max("k")).first()[0] > 8
    expected = brute_near(rows)
    assert rows_of(ngram_join.similarity_classes(docs), "doc_id", "n_shingles", "component_id") == expected
    # Only the round that verifies all that is open, in small parts, and the distributed components.
    monkeypatch.setattr(ngram_join, "PART_ROWS", 3)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    for given, brute in ((docs, expected), (spark.createDataFrame(near_rows(5, 150, 6, 3), DOC_SCHEMA), brute_near(near_rows(5, 150, 6, 3)))):
        rows, labels = ngram_join.similar_groups(given, max_rounds=1, local_edges=0)
        found = rows.join(labels, "node", "left").selectExpr("doc_id", "n_shingles", "coalesce(component, node, doc_id) AS component_id")
        assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute


def test_rounds_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "LEAST_SHARE", 0)
    rows = near_rows(6, 120, 4, 4)
    found = ngram_join.similarity_classes(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute_near(rows)


def test_few_postings_are_joined_without_shuffles(spark, monkeypatch):
    """Small tables between the passes over texts do not go through every shuffle partition, with the same result."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    rows = [(k, " ".join(w if rng.random() > 0.01 else rng.choice(words) for w in rng.choice(base)), None, None, 1) for k in range(150)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    plain, files = ngram_join.materialize, []

    def noted(df, name, **more):
        out = plain(df, name, **more)
        files.append((name, len(out.inputFiles())))
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "materialize", noted)
            found = rows_of(ngram_join.similarity_classes(docs))
        most = {name: n for name, n in files if name in ("short-pairs", "long-lists", "long", "list-sizes", "group-pairs")}
        assert len(most) >= 4 and max(most.values()) == 1
        monkeypatch.setattr(ngram_join, "few", lambda df: df)
        assert rows_of(ngram_join.similarity_classes(docs)) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
