import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, embedding, label) by integers and full scans."""
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(np.float32(x)) for x in r[1])]
    ints = lambda e: [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    rows = sorted(((i, ints(e), label) for i, e, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    dim = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dim]
    edges = [k * dim // parts for k in range(parts + 1)]
    cut = lambda v, p: v[edges[p] : edges[p + 1]]
    books = [[list(cut(r[1], p)) for r in rows[:entries]] for p in range(parts)]

    def assign():
        out = []
        for p in range(parts):
            b, x = np.array(books[p], dtype=np.int64), np.array([cut(r[1], p) for r in rows], dtype=np.int64)
            d = ((x[:, None, :] - b[None]) ** 2).sum(axis=2)
            out.append((d.argmin(axis=1), d.min(axis=1)))
        return out

    for _ in range(rounds):
        for p, (own, _) in enumerate(assign()):
            for e in set(own.tolist()):
                mine = [cut(r[1], p) for r, o in zip(rows, own, strict=True) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = assign()
    errors = [int(sum(d[k] for _, d in final)) for k in range(len(rows))]
    of_label = {}
    for r, e in zip(rows, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{own[k]:02x}" for own, _ in final), errors[k], of_label[r[2]], sha) for k, r in enumerate(rows)), key=str)


def check(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema)
    got = vc.coded(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    options.pop("block_rows", None), options.pop("n_groups", None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **options)


def clustered(rng, n, dim, centres=12, spread=0.05):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [[m + rng.gauss(0, spread) for m in rng.choice(middle)] for _ in range(n)]


@pytest.mark.parametrize(("n", "dim", "entries"), [(900, 16, 32), (300, 8, 256), (700, 10, 16)])
def test_codes_match_full_scans(spark, n, dim, entries):
    rng = random.Random(n)
    rows = [(i, v, rng.choice([1, 2, 3, None])) for i, v in enumerate(clustered(rng, n, dim))]
    rng.shuffle(rows)
    check(spark, rows, entries=entries, block_rows=100, n_groups=6)


def test_ties_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)], i % 3) for i in range(400)]  # many ties
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] * 8, 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] * 8, 1), (1005, [1.0] * 7, 1)]
    rows += [(None, [0.5] * 8, None), (7, [0.5] * 8, None), (7, [0.5] * 8, None)] + [(2000 + k, [0.25] * 8, 9) for k in range(300)]
    rng.shuffle(rows)
    check(spark, rows, entries=64, block_rows=50)
    check(spark, rows, entries=5)
    check(spark, [r for r in rows if r[0] == 7])  # one id three times, fewer rows than entries
    assert vc.coded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.coded(spark.createDataFrame([(1, None, 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([-200000, 200000]) + rng.randint(-1, 1) / 64) for _ in range(4)], 1) for i in range(200)]
    check(spark, rows, entries=20)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        vc.coded(spark.createDataFrame([(1, [1e6] * 4, 1)], SCHEMA)).collect()


def test_extra_columns_and_string_labels(spark):
    rng = random.Random(4)
    rows = [(i, v, str(i % 2)) for i, v in enumerate(clustered(rng, 60, 4))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label string, code string, own string")
    got = vc.coded(df, entries=8).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, entries=8)


def test_bounds_save_scans(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(clustered(rng, 3000, 16, centres=60))], SCHEMA)
    _, _, work = vc.compress(df, entries=64)
    assert work[0] == 3000 * 64 * 4 and all(w < 0.5 * work[0] for w in work[2:])
