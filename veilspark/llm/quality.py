"""A quality classifier from positives and unlabelled text alone: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of positives, and of unlabelled text, that the model is fitted on where there are more; the scored text has no bound.
SAMPLE = 20_000
STEPS = 600
RATE = 0.05
PENALTY = 1e-4
SEED = 11

NAMES = (
    "log_words", "distinct_words", "adjacent_repeats", "top_word", "repeated_lines", "mean_word", "long_words", "upper_letters", "digits",
    "symbols", "exclamations", "punctuated_words", "bars", "line_words", "sentence_marks", "capital_words", "repeated_blocks", "top_pair", "brackets", "other_marks",
)
_OTHER = re.compile(r"[^\w\s.,;:!?'\"|()\[\]{}<>-]", re.UNICODE)


def features(text: str) -> list[float]:
    """Shares and log counts that describe the shape of a text, not its subject. The empty text has zeros."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    blocks = [tuple(words[i : i + 8]) for i in range(0, n, 8)]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    others = len(_OTHER.findall(text))
    per = 1.0 / chars
    return [
        min(len(str(n)), 6) * 0.2,
        len(counts) / n**0.9,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        min(letters / n, 30) / 10,
        sum(len(w) > 15 for w in counts) / len(counts),
        upper / max(1, letters),
        sum(map(str.isdigit, text)) * per,
        others * per,
        text.count("!") * per,
        sum(not w[-1].isalnum() for w in words) / n,
        text.count("|") * per,
        min(n / len(lines), 200) / 100,
        (text.count(".") + text.count("?")) / n,
        sum(w[0].isupper() for w in words) / n,
        1 - len(set(blocks)) / len(blocks),
        max(pairs.values(), default=0) / n,
        sum(map(text.count, "()[]{}<>")) * per,
        others / n,
    ]


def _softplus(z):
    import numpy as np

    return np.logaddexp(0.0, z)


def _sigmoid(z):
    import numpy as np

    return 0.5 * (1 + np.tanh(0.5 * z))


def _adam(weights, gradient, steps: int):
    import numpy as np

    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return weights


def class_prior(positive, unlabelled, confidence: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives in unlabelled text, by best bin estimation (Garg et al., 2021).

    A classifier of positives against unlabelled is fitted on half of the rows. On the other half, the best bin is
    the top part of the scores whose ratio of shares, unlabelled to positive, is smallest with its confidence bound.
    """
    import numpy as np

    p, q, u, v = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]

    def gradient(w):
        return -(p.T @ _sigmoid(-(p @ w))) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + PENALTY * w

    w = _adam(np.zeros(positive.shape[1]), gradient, STEPS // 3)
    sp, su = np.sort(q @ w), np.sort(v @ w)
    cuts = np.unique(sp)
    in_p, in_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    width = np.sqrt(np.log(4 / confidence) / (2 * len(su))) + np.sqrt(np.log(4 / confidence) / (2 * len(sp)))
    best = np.argmin(in_u / in_p + (1 + slack) / in_p * width)
    return float(np.clip(in_u[best] / in_p[best], 0.01, 0.99))


def fit(positive, unlabelled) -> dict:
    """Weights of a logistic model that minimise the non-negative unbiased risk (Kiryo et al., 2017).

    With prior c the risk is c E_p[l(f)] + max(0, E_u[l(-f)] - c E_p[l(-f)]); where the second part falls under zero,
    the step goes back up on it, so that a flexible model can't explain positives away as negatives.
    """
    import numpy as np

    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6

    def scaled(x):
        return np.column_stack([np.clip((x - mean) / spread, -6, 6), np.ones(len(x))])

    p, u = scaled(positive), scaled(unlabelled)
    prior = class_prior(p, u)

    def gradient(w):
        fp, fu = p @ w, u @ w
        negative = _softplus(fu).mean() - prior * _softplus(fp).mean()
        down = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        up = -prior * (p.T @ _sigmoid(-fp)) / len(p)
        return (up + down if negative >= 0 else -down) + PENALTY * w

    return {"mean": mean, "spread": spread, "weights": _adam(np.zeros(p.shape[1]), gradient, STEPS), "prior": prior}


def scores_of(model: dict | None, x):
    import numpy as np

    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    return _sigmoid(z @ model["weights"][:-1] + model["weights"][-1])


def sampled(ids: DataFrame, rows: int) -> DataFrame:
    """About `rows` of the ids, or all if there are fewer: those whose hash is under a cut, the same ones in every run.

    The cut comes from a count, so no task gathers candidates; the number differs from rows by chance alone, a few standard deviations of its root.
    """
    ids = ids.select("doc_id").distinct()
    total = ids.count()
    if total <= rows:
        return ids
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        common.kept("quality")
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["kind", "x"])

    return docs.mapInArrow(run, "kind int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn) -> dict | None:
    """Fits on rows of docs where the condition learn holds: positives are those labelled 1, unlabelled those without a label.

    About SAMPLE rows of each kind where there are more, by hash of doc_id. None if either kind has fewer than 10 rows.
    """
    import numpy as np

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(learn)
    positive = sampled(known.where("quality = 1").join(ids, "doc_id", "left_semi"), SAMPLE)
    unlabelled = sampled(ids.join(known, "doc_id", "left_anti"), SAMPLE)
    # SAMPLE bounds this side
    chosen = F.broadcast(common.cut(positive.withColumn("kind", F.lit(1)).union(unlabelled.withColumn("kind", F.lit(0))), "chosen"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("kind", "text")
    got = _features_of(texts).toArrow()
    kind = got.column("kind").to_numpy()
    x = np.array(got.column("x").to_pylist()).reshape(len(kind), len(NAMES))
    order = np.lexsort(x.T) if len(kind) else kind
    kind, x = kind[order], x[order]
    shuffled = np.random.default_rng(SEED).permutation(len(kind))
    kind, x = kind[shuffled], x[shuffled]
    if (kind == 1).sum() < 10 or (kind == 0).sum() < 10:
        return None
    return fit(x[kind == 1], x[kind == 0])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs' columns with score, 0 to 1; without a model 0.5."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index("text")

    def run(batches):
        import numpy as np

        common.kept("quality")
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores_of(sent.value, x), pa.float64())], names=[*kept, "score"])

    frame = docs.select(*kept)
    from pyspark.sql.types import DoubleType, StructType

    return frame.mapInArrow(run, StructType([*frame.schema.fields]).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels (doc_id, quality) are learned from outside the held fold.

    A null or empty text has zero features; null doc_ids are scored but never learned from; repeated rows score
    equally; an empty docs table gives an empty one; too few labels give 0.5 throughout; other columns are
    ignored. Of several labels of one id the highest counts. A text of any length is scored whole, in memory in proportion
    to itself. Scores depend on the text alone; one at the threshold is predicted 1.
    """
    model = train(docs, labels, common.crc_fold(F.col("doc_id"), folds) != held)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(frame, model).select(
        "doc_id", (common.crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
