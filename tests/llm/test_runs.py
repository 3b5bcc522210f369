import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import periodic_runs as pr
from tests.llm.conftest import DOC_SCHEMA


def brute_runs(words, min_length=24, min_power=3):
    """By period, from the stretches where words one period apart are identical."""
    n, least = len(words), {}
    for q in range(1, n // min_power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_power * q):
                least.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((i, j - i, q) for (i, j), q in least.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind, letters, n = rng.randint(0, 5), rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 150)
    some = lambda k, top=letters: [rng.randrange(top) for _ in range(k)]
    if kind == 0:
        return some(n)
    if kind == 1:
        return [w for _ in range(rng.randint(0, 6)) for w in (some(rng.randint(1, 9)) * rng.randint(1, 20))[: rng.randint(1, 80)]]
    if kind == 2:  # runs inside longer repeats, with errors
        inner = [w for _ in range(3) for w in some(rng.randint(1, 4)) * rng.randint(3, 14)] * rng.randint(1, 5)
        for _ in range(rng.randint(0, 3)):
            inner[rng.randrange(len(inner))] = rng.randrange(letters)
        return inner
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        whole, start = some(n, 1000), rng.randint(0, n)
        p = rng.randint(1, 12)
        return whole[:start] + [whole[start + k % p] if start + k % p < n else 7 for k in range(n - start)]
    u = some(rng.randint(1, 6), 2) * rng.randint(1, 40)
    return u + some(rng.randint(0, 5), 3) + u


@pytest.mark.parametrize("limits", [(24, 3), (10, 3), (4, 2), (12, 4)])
def test_all_runs_are_found(limits):
    rng = random.Random(sum(limits))
    found = 0
    for _ in range(600):
        words = random_words(rng)
        expected = brute_runs(words, *limits)
        numbers = np.array(words, dtype=np.int64)
        assert pr.runs_of(numbers, *limits) == expected, words
        assert pr.may_repeat([numbers, numbers[:3]], pr.repeat_length(*limits))[0] or not expected
        found += len(expected)
    assert found > 400


def test_previous_factors_and_blocks():
    rng = random.Random(3)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        length, source = pr.previous_factors(pr.Names(np.array(words)))
        for i in range(len(words)):
            best = max((next((k for k in range(len(words) - i) if words[j + k] != words[i + k]), len(words) - i) for j in range(i)), default=0)
            assert length[i] == best
            assert best == 0 or (source[i] < i and words[source[i] : source[i] + best] == words[i : i + best])


def report(doc_id, text):
    words = (text or "").encode().split()
    mark = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if mark is not None and mark % 10 == 0 and words:
        g, n = mark // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@pytest.fixture(scope="session")
def repetitive(odd_rows):
    rows = list(odd_rows)
    rows += [(200 + k, "start " + "so it goes on " * (6 + k) + "end", "en", "a", 1) for k in range(30)]
    rows += [(300, "ha " * 20000, "en", "a", 1), (301, "a b  c\td\ne " * 9 + "x " + "a b c d e " * 9, "en", "a", 1), (301, "a b c d e " * 9, "en", "a", 1)]
    return rows


def test_report_matches_brute_force(spark, repetitive, empty):
    docs = spark.createDataFrame(repetitive, DOC_SCHEMA).repartition(3).select("*", F.lit("x").alias("mark"), F.lit("x").alias("start"), F.lit("x").alias("n_runs"))
    got = sorted((tuple(r) for r in pr.run_report(docs, tail=True).collect()), key=str)
    long = [r for r in repetitive if len(r[1] or "") > 50000]
    others = [r for r in repetitive if r not in long]
    expected = [report(r[0], r[1]) for r in others]
    assert [g for g in got if g[0] != 300] == sorted(expected, key=str)
    assert sum(e[1] > 0 for e in expected) > 30
    (huge,) = [g for g in got if g[0] == 300]
    assert huge[1:6] == (1, 0, 20000, 1, 20000000)
    assert pr.run_report(empty, tail=True).count() == 0


def test_collapsed_texts(spark, repetitive, empty):
    docs = spark.createDataFrame(repetitive, DOC_SCHEMA).withColumn("collapsed_text", F.lit("other"))
    out = pr.collapsed(docs)
    assert out.schema.names == docs.schema.names and out.filter("collapsed_text = 'other'").count() == len(repetitive)
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id >= 101").collect()}
    assert texts[200] == "start so it goes on end" and texts[300] == "ha" and texts[102] == " \t\n" and texts[101] == ""
    assert out.filter("doc_id = 100 and text is null").count() == 1
    assert pr.collapsed(empty).count() == 0
