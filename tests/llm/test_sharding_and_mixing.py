import re
import zlib
from collections import Counter, defaultdict

from sparkloom.llm import mixing, sharding
from tests.llm.conftest import DOC_SCHEMA, rows_of


def check_shards(found, rows, n_shards=8):
    got = found.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < n_shards for s in slots)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    return got, loads


def test_shards(odd, odd_rows, clashing, empty):
    got, _ = check_shards(sharding.shard_documents(odd), odd_rows)
    homes = defaultdict(set)
    for r in got:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())  # equal texts share a shard
    check_shards(sharding.shard_documents(clashing), odd_rows)
    assert sharding.shard_documents(empty).count() == 0


def test_even_bytes_and_hot_group(spark):
    rows = [(i, f"text number {i} " * 20, "en", "a", 1) for i in range(800)] + [(1000 + i, "copy " * 60, "en", "a", 1) for i in range(900)]
    _, loads = check_shards(sharding.shard_documents(spark.createDataFrame(rows, DOC_SCHEMA)), rows)
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 8


def test_rebalancing_moves_little():
    current = [(1, slot, 0, 1, slot % 8, 100 + slot % 7, 10) for slot in range(512)]
    grown = sharding.rebalanced(current, 9)
    assert {r[0] for r in grown} == {2} and sorted(r[1] for r in grown) == list(range(512))
    before, loads = {r[1]: r[4] for r in current}, Counter()
    for r in grown:
        loads[r[4]] += r[5]
    assert max(loads.values()) <= 1.05 * sum(loads.values()) / 9
    assert sum(before[r[1]] != r[4] for r in grown) <= 1.3 * 512 / 9


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in above}


def test_mix(spark, odd, odd_rows, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in odd_rows:
        sizes[s] += size(t)
    aims = brute_targets(sizes)
    source_of = {(d, size(t)): s for d, t, _, s, _ in odd_rows}
    for docs in (odd, clashing):
        got = mixing.mix(docs, labels).collect()
        assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((d, size(t)) for d, t, *_ in odd_rows), key=str)
        taken = Counter()
        for r in got:
            s = source_of[r["doc_id"], r["size"]]
            assert abs(r["target"] - aims[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
        assert all(abs(taken[s] - aims[s]) <= 2 for s in sizes)
    assert rows_of(mixing.mix(odd, labels)) == rows_of(mixing.mix(odd.repartition(5), labels))
    assert mixing.mix(empty, labels).count() == 0


def test_mixed_documents_have_the_words(odd, odd_rows, clashing, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in odd_rows:
        sizes[s] += size(t)
    for docs in (odd, clashing):
        out = mixing.mix_documents(docs)
        assert out.columns == docs.columns
        taken = Counter()
        for r in out.select("text", "source").collect():
            taken[r["source"]] += size(r["text"])
        assert all(abs(taken[s] - a) <= 2 for s, a in brute_targets(sizes).items())
    assert mixing.mix_documents(empty).count() == 0


def test_mixed_documents_follow_labels(spark, odd, clashing):
    rows = [(i, f"word{i} " * (60 if i % 2 else 5), "en", "ab"[i // 100], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    for some, marks in ((docs, labels), (odd, labels), (clashing, labels)):
        planned, mixed = Counter(), Counter()
        for r in mixing.mix(some, marks).collect():
            planned[r["doc_id"]] += r["taken"]
        for r in mixing.mix_documents(some, marks).select("doc_id", "text").collect():
            mixed[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert +planned == +mixed


def test_pipeline_stage_reads_labels(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"word{i} " * 60, "en", "ab"[i // 100], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    of_b = Counter(r["doc_id"] % 2 for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).filter("source = 'b'").select("doc_id").collect())
    assert of_b[1] > 3 * of_b[0]


def test_cut_document_keeps_its_line_breaks(spark):
    text = "\n\n".join(f"word{i}\tnext  line" for i in range(50))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "en", "b", 1)], DOC_SCHEMA)
    got = [r["text"] for r in mixing.mix_documents(docs).collect()]
    assert any(t != text for t in got) and all(text.startswith(t) for t in got)
