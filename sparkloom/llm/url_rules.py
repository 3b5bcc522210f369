"""URL filtering by stated rules and by association rules mined from labels.

Stated rules (host and path prefix, allow or block) come first: a rule fits
its host and all subdomains if the path starts with the rule's; the longest
fitting rule wins. They also give the labels: every URL that a rule fits is a
labelled example.

For the other URLs, FP-growth mines combinations of URL tokens (host labels,
the suffixes of the host, path folders, scheme and query keys) that go with
one verdict. Rules below ``MIN_CONFIDENCE`` or ``MIN_SUPPORT``, and rules that
a shorter rule of the same verdict already covers at no less confidence, are
pruned. Tokens that exactly the same labelled URLs have are mined as one
(a host's labels, its suffixes and the folders that all its URLs share): of
such tokens a rule that needs two is always covered by one that needs either,
so only one of them at a time stands in a rule. Matching uses an inverted index: each rule is listed under its rarest
token, a URL's tokens are joined with the index, and a candidate counts if the
URL has all its tokens. The most confident rule wins, then the better
supported one, then the longer one, then the smaller token list.

Everything is DataFrame functions and MLlib's FP-growth; the main path runs no
Python on the executors. URLs are judged once however often they repeat.

Defined results: a null URL or one without ``://`` has an empty host and path,
no tokens, and gets the default verdict (the majority of the labels, ``allow``
if there are none or on a tie); repeated rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Labelled URLs that FP-growth sees at most (about): a bound on what is learned from, not on what is judged.
SAMPLE = 200_000
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Rules up to this length prune the others first; it changes no result.
FIRST_TOKENS = 2
LABEL = "verdict="


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written like ``net/``, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; none without a host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("suffix="), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    placed = F.transform(folders, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    found = F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("host="), x)), suffixes, placed, keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, host, path, rule, rule_verdict, tokens for each distinct URL."""
    host, path = split_url(F.col("url"))
    split = pages.select("url").distinct().withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return split.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def token_classes(kept: DataFrame, least: float, total: int) -> DataFrame:
    """class, tokens: the tokens of at least ``least`` and not all ``total`` URLs, those with the same URLs together.

    URLs of a token are compared by their number and 128 bits of hashes. A token that all
    URLs have says nothing about the verdict. There are at most tokens-a-URL * total / least tokens.
    """
    covers = kept.select("url", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("url")).alias("h"), F.bit_xor(F.xxhash64(F.lit("second"), "url")).alias("g")
    ).filter((F.col("n") >= least) & (F.col("n") < total))
    return covers.groupBy("n", "h", "g").agg(F.min("token").alias("class"), F.array_sort(F.collect_list("token")).alias("tokens")).select("class", "tokens")


def mined_classes(labelled: DataFrame, sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(needs, verdict, confidence, support over classes of tokens; the classes) from ``url``, ``tokens`` and ``rule_verdict``.

    Tokens below the support can be in no rule and are left out first, so
    the transactions are short.
    """
    n = labelled.count()
    # A share of the 64-bit hashes, so that no count is so large that nothing is drawn.
    limit = (1 << 63) - 1 if n <= sample else (sample << 64) // n - (1 << 63)
    kept = labelled.filter(F.xxhash64("url") <= F.lit(limit))
    total = max(1, kept.count())
    classes = materialize(token_classes(kept, min_support * total, total), "url-token-classes")
    # At most tokens-a-URL / min_support rows, whatever the input.
    named = F.broadcast(classes.select("class", F.explode("tokens").alias("token")))
    items = (
        kept.select("url", "rule_verdict", F.explode("tokens").alias("token")).join(named, "token")
        .groupBy("url", "rule_verdict").agg(F.collect_set("class").alias("items"))
        .select(F.concat("items", F.array(F.concat(F.lit(LABEL), F.col("rule_verdict")))).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL)).filter(
        ~F.exists("antecedent", lambda x: x.startswith(LABEL))
    )
    return rules.select(
        F.array_sort("antecedent").alias("needs"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 100).alias("verdict"),
        F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"),
    ), classes


def spelled(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over classes as rules over tokens: one for each choice of a token from every class."""
    rest = [c for c in rules.columns if c not in ("needs", "rule_id")]
    members = (
        rules.select("needs", *rest, F.explode("needs").alias("class")).join(F.broadcast(classes), "class")
        .groupBy("needs", *rest).agg(F.collect_list("tokens").alias("members"))
    )
    none = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("members", none, lambda made, tokens: F.flatten(F.transform(made, lambda m: F.transform(tokens, lambda t: F.concat(m, F.array(t))))))
    return members.select(F.explode(choices).alias("chosen"), *rest).select(F.array_sort("chosen").alias("needs"), *rest)


def mined(labelled: DataFrame, sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """needs, verdict, confidence, support over tokens, with at most one token of each class in a rule."""
    return spelled(*mined_classes(labelled, sample, min_support, min_confidence))


def uncovered(rules: DataFrame, short: DataFrame) -> DataFrame:
    """Without rules that a shorter one of ``short`` of the same verdict covers at no less confidence."""
    short = short.select(F.col("needs").alias("s_needs"), F.col("verdict").alias("s_verdict"), F.col("confidence").alias("s_confidence"), F.col("needs")[0].alias("s_first"))
    # A shorter rule shares its own first token with the longer one: an equality join on that token.
    longer = rules.withColumn("token", F.explode("needs")).join(
        short,
        (F.col("token") == F.col("s_first")) & (F.col("verdict") == F.col("s_verdict")) & (F.size("s_needs") < F.size("needs"))
        & (F.col("s_confidence") >= F.col("confidence")) & (F.size(F.array_except("s_needs", "needs")) == 0),
    ).select("needs", "verdict")
    return rules.join(longer.distinct(), ["needs", "verdict"], "left_anti")


def pruned(rules: DataFrame) -> DataFrame:
    """Without rules that a shorter one of the same verdict covers at no less confidence.

    What covers a rule also covers all that the rule covers, so the few
    shortest rules go first and only what they leave is compared with itself.
    """
    left = materialize(uncovered(rules, rules.filter(F.size("needs") <= FIRST_TOKENS)), "url-rules-left")
    return numbered(uncovered(left, left))


def numbered(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rule_id", F.xxhash64("needs", "verdict"))


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The inverted index: each rule once, under its rarest token."""
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    return (
        rules.withColumn("token", F.explode("needs")).join(counts, "token", "left")
        .withColumn("k", F.row_number().over(rarest)).filter("k = 1").drop("k", "n")
    )


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined_verdict, confidence for the URLs that some mined rule matches."""
    tokens = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("needs").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = materialize(indexed(rules, counts), "url-rule-index")
    small = index.count() <= 20_000  # about 200 bytes each
    best = F.struct("confidence", "support", F.size("needs").alias("length"), F.concat_ws(" ", "needs").alias("name"), "verdict")
    return (
        tokens.join(F.broadcast(index) if small else index, "token")
        .filter(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("url").agg(F.max(best).alias("best"))
        .select(F.col("url").alias("m_url"), F.col("best.verdict").alias("mined_verdict"), F.col("best.confidence").alias("confidence"), F.col("best.name").alias("mined_rule"))
    )


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each page."""
    urls = materialize(parsed(pages, rules), "urls")
    labelled = urls.filter(F.col("rule_verdict").isNotNull())
    over_classes, classes = mined_classes(labelled, sample, min_support, min_confidence)
    # What covers a rule over classes covers the same choices of tokens, so rules are pruned before they are spelled out.
    found = materialize(numbered(spelled(pruned(materialize(over_classes, "mined-rules")), classes)), "url-rules")
    sides = {r["rule_verdict"]: r["count"] for r in labelled.groupBy("rule_verdict").count().collect()}
    default = "block" if sides.get("block", 0) > sides.get("allow", 0) else "allow"
    matched = by_rules(urls.filter(F.col("rule_verdict").isNull()), found)
    judged = urls.drop("tokens").join(matched, urls["url"].eqNullSafe(F.col("m_url")), "left").select(
        F.col("url").alias("j_url"), "host", "path", "rule",
        F.coalesce("rule_verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined_rule", "confidence",
    )
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("j_url"))).drop("url", "j_url")


def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
