"""Language identification: family first, then pairwise machines inside it.

Features are the 1- to 4-grams of the letters of each word (letters and marks,
lower-cased, with one mark of a word's end at both ends), hashed to
``N_FEATURES``; a text's vector holds the square roots of its counts, scaled to
length 1. Grams are hashed as arrays of code points, in pieces of
``PIECE_CHARS``, so no word becomes an object and a text without blanks is a
text like others.

Families are found from the training texts: the languages' mean feature
vectors are joined, closest pair first (average cosine), until about the
square root of their number is left. One-versus-one linear support vector
machines separate the families, and others separate the languages within each
family. The model is fitted by dual coordinate descent on a bounded sample:
the ``PER_LANGUAGE`` distinct whole texts of each language whose hashes are
smallest (fewer if there are so many languages that ``MAX_SAMPLE`` texts would
be exceeded, but one at least), so copies count once and no language is lost.

The score is the product, over the two levels, of the logistic value of the
winner's smallest margin over a rival; it lies in (0, 1].

Defined results: ``und`` with score 0 for null, for texts without a letter,
and for every text if there is nothing to learn from; one training language
is predicted throughout with score 1; ties go to the smaller name; repeated
rows get equal rows; other columns are ignored by ``identify`` and kept as they
are by ``predict``, which takes names for its own two.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, read_table, small_batches, trimmed

N_FEATURES = 1 << 13
PER_LANGUAGE = 400
#: Texts that come to the driver as vectors (of 4 * N_FEATURES bytes), unless there are more languages than that.
MAX_SAMPLE = 4000
PIECE_CHARS = 1 << 18
UNKNOWN = "und"
#: For each code point 2 (letter), 1 (mark) or 0; filled by a worker when it first needs it (1 MB).
_kinds: list = []


def held_out(column: str = "doc_id") -> Column:
    """True for the documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def kinds():
    import numpy as np

    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8))
    return _kinds[0]


def gram_pieces(text: str) -> Iterator:
    """The hashed 1- to 4-grams of a text, piece by piece; nothing for a text without a letter."""
    import numpy as np

    codes_of = lambda part: np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table = kinds()
    if not any((table[codes_of(text[at : at + PIECE_CHARS])] == 2).any() for at in range(0, len(text), PIECE_CHARS)):
        return
    text = text.lower() + " "
    carry, inside = np.zeros(1, dtype=np.uint64), False
    for at in range(0, len(text), PIECE_CHARS):
        codes = codes_of(text[at : at + PIECE_CHARS])
        letter = table[codes] > 0
        # Of a run of other characters only the first stays, as 0: a word's end.
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= inside
        inside = bool(letter[-1])
        line = np.concatenate([carry, np.where(letter, codes, 0)[kept].astype(np.uint64)])
        found = []
        rolled = np.zeros(len(line), dtype=np.uint64)
        for n in range(1, 5):
            rolled = rolled[: len(line) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + line[n - 1 :] + np.uint64(1)
            first = max(0, len(carry) - n + 1)  # what lies in the carry alone has been counted
            good = np.ones(len(rolled), dtype=bool) if n > 1 else line > 0
            for inner in range(1, n - 1):
                good &= line[inner : inner + len(rolled)] > 0
            grams = rolled[first:][good[first:]]
            found.append(((grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) >> np.uint64(64 - N_FEATURES.bit_length() + 1)).astype(np.int64))
        carry = line[-3:]
        yield np.concatenate(found)


def vector_of(text: str | None):
    """The feature vector (float32), or None for a text without a letter."""
    import numpy as np

    counts = None
    for grams in gram_pieces(text or ""):
        new = np.bincount(grams, minlength=N_FEATURES)
        counts = new if counts is None else counts + new
    if counts is None:
        return None
    vector = np.sqrt(counts, dtype=np.float32)
    return vector / np.sqrt(vector @ vector)


class Model:
    """Weights of the machines of both levels; plain data, a few MB at most."""

    def __init__(self, families: list[list[str]], weights, bias, between: list[tuple[int, int]], within: list[tuple[str, str]]):
        self.families, self.weights, self.bias, self.between, self.within = families, weights, bias, between, within

    def decide(self, values) -> tuple[str, float]:
        """The winning language of the winning family, and the score, from the machines' values."""
        family, p = winner(range(len(self.families)), self.between, values[: len(self.between)])
        names = self.families[family]
        pairs = [(k, pair) for k, pair in enumerate(self.within) if pair[0] in names]
        lang, q = winner(names, [pair for _, pair in pairs], [values[len(self.between) + k] for k, _ in pairs])
        return lang, p * q


def winner(names, pairs, margins):
    """Most wins, then the larger sum of margins, then the smaller name; its least logistic value."""
    import math

    wins, total, least = {n: 0 for n in names}, {n: 0.0 for n in names}, {n: 1.0 for n in names}
    for (a, b), m in zip(pairs, margins, strict=True):
        for name, value in ((a, m), (b, -m)):
            wins[name] += value > 0
            total[name] += value
            least[name] = min(least[name], 1 / (1 + math.exp(-max(-50.0, min(50.0, 2 * value)))))
    best = min(names, key=lambda n: (-wins[n], -total[n], n))
    return best, least[best]


def featurized(rows: DataFrame) -> DataFrame:
    """lang and the feature vector (float32 bytes) of each whole text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, vectors = [], []
            for k in range(batch.num_rows):
                vector = vector_of(batch.column(1)[k].as_py())
                if vector is not None:
                    langs.append(batch.column(0)[k].as_py())
                    vectors.append(vector.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], ["lang", "vector"])

    return rows.select("lang", "text").mapInArrow(trimmed(run), "lang string, vector binary")


def hash_limit(wanted: int, distinct: int) -> int:
    """The largest 64-bit hash that is drawn so that some more than ``wanted`` of ``distinct`` values are expected."""
    enough = 4 * wanted + 64
    return (1 << 63) - 1 if distinct <= enough else (enough << 64) // distinct - (1 << 63)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """lang, text: the distinct texts of each language with the smallest hashes, none held out."""
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return usable.select("lang", "text").limit(0)
    wanted = max(1, min(per_language, max_sample // len(counts)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], hash_limit(wanted, r["n"])) for r in counts], "drawn string, h_limit long")
    few = usable.join(F.broadcast(limits), F.col("lang") == F.col("drawn")).filter("h <= h_limit").groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    return few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= wanted).select("lang", "text")


def fit_svm(x, y, cost: float = 20.0, epochs: int = 30):
    """Weights and bias of an L2-regularised, squared-hinge machine (dual coordinate descent)."""
    import numpy as np

    norms = np.einsum("ij,ij->i", x, x) + 1 + 1 / (2 * cost)  # the 1 is the bias's constant feature
    alpha, w, bias = np.zeros(len(x)), np.zeros(x.shape[1], dtype=x.dtype), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            gradient = y[i] * (float(x[i] @ w) + bias) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += x.dtype.type(step) * x[i]
                bias += step
                alpha[i] = new
    return w, bias


def find_families(means: dict[str, object]) -> list[list[str]]:
    """Average-linkage families of the languages, about the square root of their number."""
    import math

    import numpy as np

    names = sorted(means)
    centre = np.mean([means[n] for n in names], axis=0)
    unit = {n: (means[n] - centre) / (np.linalg.norm(means[n] - centre) or 1.0) for n in names}
    groups = [[n] for n in names]
    while len(groups) > max(1, math.isqrt(len(names))):
        close = lambda p: (-np.mean([unit[a] @ unit[b] for a in groups[p[0]] for b in groups[p[1]]]), p)
        i, j = min(combinations(range(len(groups)), 2), key=close)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model, or None if no labelled text can be learned from.

    The sample's vectors come to the driver: at most ``MAX_SAMPLE`` x 32 KB,
    whatever the corpus.
    """
    import numpy as np

    with small_batches(docs.sparkSession):
        rows = featurized(training_sample(docs, per_language)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    langs = np.array([r["lang"] for r in rows])
    x = np.vstack([np.frombuffer(r["vector"], dtype=np.float32) for r in rows])
    del rows
    families = find_families({lang: x[langs == lang].mean(axis=0) for lang in sorted(set(langs.tolist()))})
    family_of = {lang: k for k, names in enumerate(families) for lang in names}
    member = np.array([family_of[lang] for lang in langs])
    between = list(combinations(range(len(families)), 2))
    within = [pair for names in families for pair in combinations(names, 2)]
    columns, bias = [], []
    for key, pairs in ((member, between), (langs, within)):
        for a, b in pairs:
            mine = (key == a) | (key == b)
            w, b0 = fit_svm(x[mine], np.where(key[mine] == a, 1.0, -1.0))
            columns.append(w)
            bias.append(b0)
    weights = np.array(columns).T if columns else np.zeros((N_FEATURES, 0))
    return Model(families, np.ascontiguousarray(weights, dtype=np.float32), np.array(bias), between, within)


def predict(docs: DataFrame, model: Model | None, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row; all other columns stay.

    The two names must be new ones.
    """
    taken = {c.lower() for c in docs.columns}
    if {lang_name.lower(), score_name.lower()} & taken:
        raise ValueError(f"{lang_name} or {score_name} is a column already; choose other names")
    return judged(docs, model, docs.columns, lang_name, score_name)


def judged(docs: DataFrame, model: Model | None, keep: list[str], lang_name: str, score_name: str) -> DataFrame:
    """The columns ``keep`` of every row, its language and its score; the text goes to Python last and need not come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[f"`{c}`" for c in keep])

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            langs, scores = [], []
            for k in range(batch.num_rows):
                lang, score = UNKNOWN, 0.0
                vector = vector_of(texts[k].as_py()) if model else None
                if vector is not None:
                    lang, score = model.decide(vector @ model.weights + model.bias)
                langs.append(lang)
                scores.append(score)
            columns = [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: len(keep)], lang_name, score_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{lang_name}` string, `{score_name}` double"
    return docs.select(*[f"`{c}`" for c in keep], F.col("text").alias(fresh(keep, "text"))).mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fit(docs, per_language)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    with small_batches(docs.sparkSession):
        return materialize(judged(rows, model, ["doc_id", "held_out"], "lang_pred", "score"), "languages")


def op2_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
