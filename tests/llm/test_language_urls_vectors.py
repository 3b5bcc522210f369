import math
import random

import pytest

from sparkloom.llm import language_id, pivot_topk, url_rules
from tests.llm.conftest import DOC_SCHEMA, rows_of

VOCABULARY = {
    "en": "the of and stone with river house thing night which that from over".split(),
    "nl": "het van en steen met rivier huis ding nacht welke dat uit boven".split(),
    "es": "el de y piedra con río casa cosa noche cual que desde sobre".split(),
    "pt": "o do e pedra com rio casa coisa noite qual que desde sobre ão ções".split(),
}


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(8, 60))), lang, "a", 1) for i in range(600) for lang in [rng.choice(list(VOCABULARY))]]
    rows += [(900, None, "en", "a", 1), (901, "", "en", "a", 1), (902, "12 ... !", "en", "a", 1), (903, "river", None, "a", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [r for d, r in got.items() if r["held_out"] and d < 900]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (900, 901, 902))
    assert got[903]["lang_pred"] in VOCABULARY and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edge_cases(spark, odd, odd_rows, clashing, empty):
    assert language_id.identify(clashing).count() == len(odd_rows)
    assert language_id.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, None, None)], DOC_SCHEMA)
    assert rows_of(language_id.identify(unlabelled), "lang_pred", "score") == [("und", 0.0)]
    one = spark.createDataFrame([(1, "some text", "en", None, None), (2, "more", "en", None, None)], DOC_SCHEMA)
    assert rows_of(language_id.identify(one), "lang_pred", "score") == [("en", 1.0)] * 2


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def page_rows():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = rng.choice(["", "www.", "m."]) + rng.choice(["a", "b"]) + "." + rng.choice(["example.org", "example.com", "example.net"])
        rows.append((i, f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'de', 'fr'])}/{rng.randint(1, 300)}{rng.choice(['', '.html', '?page=2', '#top'])}", "<p>"))
    rows += [(900, None, None), (901, "", ""), (902, "no scheme/en/", ""), (903, "http://EXAMPLE.Org", ""), (904, "http://example.org/", ""), (904, "http://example.org/", ""), (905, "x://notexample.org/es/1", ""),
             (906, "http://example.com?de/", ""), (907, "a://b://c/d", ""), (None, "http://q.com/de/", "")]
    return rows


def test_url_rules_and_mined_rules(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_rules.filter_urls(pages, min_support=0.01).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str) == sorted(((p, *rule_of(u)[:3]) for p, u, _ in rows), key=str)
    verdicts = {p: rule_of(u)[3] for p, u, _ in rows if u}
    assert all(r["verdict"] == verdicts.get(r["page_id"]) for r in got if r["rule"])
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    # Brute force over the mined rules.
    urls = url_rules.parsed(pages).cache()
    labelled = urls.filter("rule_verdict is not null")
    rules = url_rules.pruned(url_rules.mined(labelled, min_support=0.01)).collect()
    tokens = {r["url"]: set(r["tokens"]) for r in urls.collect()}
    url_of = {p: u for p, u, _ in rows}
    n = {v: sum(1 for r in labelled.collect() if r["rule_verdict"] == v) for v in ("allow", "block")}
    default = "block" if n["block"] > n["allow"] else "allow"
    for r in got:
        if r["rule"] is None:
            fits = [x for x in rules if set(x["needs"]) <= tokens[url_of[r["page_id"]]]]
            best = max(fits, key=lambda x: (x["confidence"], x["support"], len(x["needs"]), " ".join(x["needs"])), default=None)
            assert r["verdict"] == (best["verdict"] if best else default)
    for rule in rules:
        both = [r for r in labelled.collect() if set(rule["needs"]) <= set(r["tokens"])]
        assert abs(sum(r["rule_verdict"] == rule["verdict"] for r in both) / len(both) - rule["confidence"]) < 1e-6


def test_url_edge_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.filter_urls(none).count() == 0
    from pyspark.sql import functions as F

    rows = page_rows()[:50]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "tokens", "token", "verdict", "n", "k")])
    assert url_rules.filter_urls(pages).count() == 50


def test_pivot_topk_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(500)]
    rows += [(600, None), (700, []), (800, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, [0.5] * 6), (1101, [0.5] * 6), (1101, [0.5] * 6), (1200, [1.0, 2.0]), (1201, [3.0, 1.0]), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    clean = {i: tuple(math.floor(1024 * single(x)) for x in v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q, a in clean.items():
        if q % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean.items() if i != q and len(a) == len(b)))[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    found = pivot_topk.nearest(vectors, vectors.filter("vec_id % 100 = 0"))
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(expected, key=str)
    assert pivot_topk.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    # Several groups, with lines from the first ones; names that are used inside.
    clashing = vectors.selectExpr("*", "1 AS number", "'x' AS bucket", "2 AS g", "3 AS dim", "'y' AS ids", "4 AS key", "5 AS lines")
    found = pivot_topk.nearest(clashing, clashing.filter("vec_id % 100 = 0"), group_rows=60)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(expected, key=str)


def test_pivots_eliminate(spark):
    rng = random.Random(18)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hits = pivot_topk.meet_all(vectors, vectors.filter("vec_id % 100 = 0"), group_rows=500)
    evaluated = hits.agg({"evaluated": "sum"}).first()[0]
    assert evaluated < 0.5 * 30 * 3000
    none = pivot_topk.meet_all(vectors, vectors.filter("vec_id % 100 = 0"), n_pivots=1, group_rows=500)
    assert none.agg({"evaluated": "sum"}).first()[0] > evaluated
    assert rows_of(pivot_topk.ranked(hits, 10)) == rows_of(pivot_topk.ranked(none, 10))


def test_draws_never_come_to_nothing():
    for wanted, rows in ((300, 3 * 10**9), (2048, 10**13), (1, 10**18), (5, 3)):
        for limit in (pivot_topk.hash_limit(wanted, rows), language_id.hash_limit(wanted, rows)):
            assert min(rows, wanted) <= (limit + (1 << 63)) * rows / (1 << 64) + 1e-6 and -(1 << 63) <= limit < 1 << 63


def test_a_language_of_copies_and_a_text_without_blanks(spark):
    rng = random.Random(14)
    text = lambda lang: " ".join(rng.choice(VOCABULARY[lang]) for _ in range(20))
    rows = [(i, "river stone house night which that from over", "en", "a", 1) for i in range(600)]
    rows += [(1000 + i, text("nl"), "nl", "a", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    counts = {r["lang"]: r["count"] for r in language_id.training_sample(docs, 100).groupBy("lang").count().collect()}
    assert counts == {"en": 1, "nl": 100}
    assert language_id.training_sample(docs, 100, max_sample=1).count() == 2
    found = {r["lang_pred"] for r in language_id.identify(docs).filter("doc_id < 1000").select("lang_pred").distinct().collect()}
    assert found == {"en"}
    long = "riverstonehouse" * 60_000
    pieces = language_id.vector_of(long)
    old = language_id.PIECE_CHARS
    try:
        language_id.PIECE_CHARS = 777
        assert (language_id.vector_of(long) == pieces).all() and abs(float(pieces @ pieces) - 1) < 1e-4
        some = "Voilà,  l'été — 12 naïve coöperatie\n\tx " * 50
        cut = language_id.vector_of(some)
        language_id.PIECE_CHARS = old
        assert (language_id.vector_of(some) == cut).all()
    finally:
        language_id.PIECE_CHARS = old
    assert language_id.vector_of("12 - ...") is None and language_id.vector_of(None) is None


def test_language_keeps_the_callers_columns(spark, odd):
    from pyspark.sql import functions as F

    own = odd.withColumn("score", F.lit("mine")).withColumn("_letters", F.lit("too"))
    model = language_id.fit(own)
    got = language_id.predict(own, model, "found", "sure").collect()
    assert all(r["score"] == "mine" and r["_letters"] == "too" and 0 <= r["sure"] <= 1 for r in got)
    with pytest.raises(ValueError, match="score"):
        language_id.predict(own, model)


def test_rules_of_more_than_three_tokens(spark):
    rows = []
    for i in range(320):
        has = [t for k, t in enumerate("abcde") if i >> k & 1]
        rows.append((f"u{i}", has, "block" if set("abcd") <= set(has) else "allow"))
    labelled = spark.createDataFrame(rows, "url string, tokens array<string>, rule_verdict string")
    mined = url_rules.mined(labelled, min_support=0.01)
    every = [(frozenset(r["needs"]), r["verdict"], r["confidence"]) for r in mined.collect()]
    got = {(frozenset(r["needs"]), r["verdict"]) for r in url_rules.pruned(mined).collect()}
    assert got == {(n, v) for n, v, c in every if not any(m < n and v == w and d >= c for m, w, d in every)}
    assert (frozenset("abcd"), "block") in got
    urls = spark.createDataFrame([("x", list("abcd")), ("y", list("abc"))], "url string, tokens array<string>")
    assert {r["m_url"]: r["mined_verdict"] for r in url_rules.by_rules(urls, url_rules.pruned(mined)).collect()}["x"] == "block"


def test_mined_rules_are_those_of_all_token_sets(spark):
    from itertools import chain, combinations

    rng = random.Random(3)
    rows = []
    for i in range(200):
        has = [t for t in "abcd" if rng.random() < 0.5]
        has += ["same1", "same2", "same3"] if "a" in has else []  # with the URLs of a
        rows.append((f"u{i}", sorted(has), "block" if "a" in has and "b" in has or rng.random() < 0.2 else "allow"))
    labelled = spark.createDataFrame(rows, "url string, tokens array<string>, rule_verdict string")
    every = {}
    tokens = sorted({t for _, has, _ in rows for t in has})
    for needs in chain.from_iterable(combinations(tokens, k) for k in range(1, len(tokens) + 1)):
        fits = [v for _, has, v in rows if set(needs) <= set(has)]
        for v in ("allow", "block"):
            if fits and fits.count(v) >= 0.05 * len(rows) and fits.count(v) >= 0.6 * len(fits):
                every[frozenset(needs), v] = round(fits.count(v) / len(fits), 9)
    wanted = {(n, v) for (n, v), c in every.items() if not any(m < n and v == w and d >= c for (m, w), d in every.items())}
    found = url_rules.pruned(url_rules.mined(labelled, min_support=0.05)).collect()
    assert {(frozenset(r["needs"]), r["verdict"]) for r in found} == wanted and len(found) == len(wanted)
    over_classes, classes = url_rules.mined_classes(labelled, min_support=0.05)
    assert ["a", "same1", "same2", "same3"] in [r["tokens"] for r in classes.collect()]
    found = url_rules.spelled(url_rules.pruned(over_classes), classes).collect()
    assert {(frozenset(r["needs"]), r["verdict"]) for r in found} == wanted and len(found) == len(wanted)


def test_many_shared_folders(spark):
    deep = "/".join(f"f{k}" for k in range(14))
    urls = [f"http://a.b.example.org/es/{deep}/{i}x{i}" for i in range(60)] + [f"http://w{i % 7}.shop.com/fr/p{i}" for i in range(60)]
    urls += [f"http://c.net/xx/{deep}/{i}" for i in range(3)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(pages, min_support=0.05).collect()}
    # The last three have the blocked host's folders, and no stated rule.
    assert len(got) == 123 and {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 120)} == {"allow"} and {got[i] for i in range(120, 123)} == {"block"}
