"""Quality classifier from weak labels: heuristic labellers, EM for their accuracies, a hashed scorer."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare_python, uniform

#: The scorer is trained on the whole texts of about so many documents, those of least hash (bounded sample).
TRAIN_ROWS = 6_000
#: Their features are about so many bytes at most; where texts are long, fewer documents are drawn.
TRAIN_BYTES = 256 << 20
#: Words of a block; variety is measured inside blocks, so that it means the same at every length.
VARIETY = 300
#: Buckets of hashed byte trigrams; one more holds the share of words that repeat the one before.
BUCKETS = 1 << 15
#: A document is rejected if its score is below this.
THRESHOLD = 0.35
#: Prior of a labeller's firings on good and on bad documents (pseudo-counts: fired, silent): it is
#: seldom wrong on a good document, and each finds its own kind of bad ones.
FALSE_ALARMS, HITS = (1.0, 199.0), (3.0, 6.0)
#: Prior of the share of good documents (pseudo-counts: good, bad).
SHARE = (80.0, 20.0)
#: Names of the labellers, in the order of their votes.
LABELLERS = ("odd_symbols", "odd_words", "upper_case", "exclaimed", "few_words", "few_pairs", "same_again", "bare_marks", "no_sentences", "long_words", "few_letters")

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _MARK = range(6)
_MARKS = ".,;:!?'\"()-–—…¿¡«»„“”’"


def _class_of(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    if kind == "Lu":
        return _UPPER
    if kind[0] in "LM":
        return _LOWER
    if kind[0] == "N":
        return _DIGIT
    if c.isspace():
        return _SPACE
    return _MARK if c in _MARKS else _OTHER


#: The class of each code point below U+3000; those from there on count as lower-case letters.
_CLASSES = np.array([_class_of(i) for i in range(0x3000)], dtype=np.uint8)


def votes(text: str | None) -> list[int]:
    """1 (bad) or 0 (silent) from each labeller; a null, empty or blank text gets 1 from the last."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0] * (len(LABELLERS) - 1) + [1]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = np.where(points < 0x3000, _CLASSES[np.minimum(points, 0x2FFF)], _LOWER)
    other, lower, upper, _, space, _ = np.bincount(kinds, minlength=6).tolist()
    solid, letters = len(points) - space, lower + upper
    odd = kinds == _OTHER
    runs = int((odd[1:] & ~odd[:-1]).sum()) + int(odd[0])  # odd runs, each in a word of its own as a rule
    bangs, stops = text.count("!"), sum(map(text.count, ".!?…"))
    bare = sum(len(w) == 1 and not w.isalnum() for w in words)
    blocks = [words[i : i + VARIETY] for i in range(0, n, VARIETY)]
    kinds_of, pairs_of = sum(len(set(b)) for b in blocks), sum(len(set(zip(b, b[1:], strict=False))) for b in blocks)
    return [
        int(other > 0.05 * solid),
        int(n >= 5 and runs > 0.2 * n),
        int(letters >= 10 and upper > 0.5 * letters),
        int(n >= 5 and bangs > 0.3 * n),
        int(n >= 20 and kinds_of < 0.3 * n),
        int(n >= 20 and pairs_of < 0.55 * (n - len(blocks))),
        int(n >= 5 and sum(map(operator.eq, words, words[1:])) > 0.25 * (n - 1)),
        int(n >= 5 and bare > 0.15 * n),
        int(n >= 40 and stops * 40 < n),
        int(solid > 15 * n),
        int(letters < 0.6 * solid),
    ]


def _code(text: str | None) -> int:
    return int("".join(map(str, votes(text))), 2)


def _as_code(batch: pd.Series) -> pd.Series:
    return pd.Series(list(map(_code, batch)), dtype="int64")


def estimate(patterns: list[tuple[int, int]], rounds: int = 200) -> tuple[dict[int, float], dict[str, tuple[float, float]], float]:
    """EM for two classes and labellers that fire independently given the class.

    patterns: (vote code, number of documents). Returns the posterior of "good" for each code, each
    labeller's accuracies (silent on a good document, fires on a bad one) and the share of good
    documents. It starts from "good if nothing fires"; the priors above are added as pseudo-counts.
    No pattern: the priors' share.
    """
    if not patterns:
        return {}, {}, SHARE[0] / sum(SHARE)
    codes = [c for c, _ in patterns]
    weight = np.array([n for _, n in patterns], dtype=float)
    width = len(LABELLERS)
    v = np.array([[c >> (width - 1 - i) & 1 for i in range(width)] for c in codes], dtype=float)
    good = np.where(v.any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        g, b = weight * good, weight * (1 - good)
        share = (g.sum() + SHARE[0]) / (weight.sum() + sum(SHARE))
        on_good = (v.T @ g + FALSE_ALARMS[0]) / (g.sum() + sum(FALSE_ALARMS))
        on_bad = (v.T @ b + HITS[0]) / (b.sum() + sum(HITS))
        odds = np.log(share / (1 - share)) + v @ np.log(on_good / on_bad) + (1 - v) @ np.log((1 - on_good) / (1 - on_bad))
        after = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done = np.abs(after - good).max() < 1e-9
        good = after
        if done:
            break
    accuracy = {name: (float(1 - a), float(b)) for name, a, b in zip(LABELLERS, on_good, on_bad, strict=True)}
    return dict(zip(codes, good.tolist(), strict=True)), accuracy, float(share)


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: their buckets and values.

    Hashed byte trigrams (case and digits kept) and words that repeat the one before, each the
    square root of its share.
    """
    b = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.float32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    if len(h) < BUCKETS // 8:
        found, counts = np.unique(h, return_counts=True)
    else:
        counts = np.bincount(h, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        counts = counts[found]
    words = text.split()
    again = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
    return np.append(found, BUCKETS).astype(np.uint16), np.sqrt(np.append(counts / len(h), again)).astype(np.float32)


class Scorer:
    """Linear on hashed trigrams alone; picklable. The labellers' posterior is its target, never its input."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        """0 to 1; a null, empty or blank text scores 0."""
        if not (text or "").strip():
            return 0.0
        at, values = hashed(text)
        z = self.bias + float(values @ self.weights[at])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(some: list[tuple[np.ndarray, np.ndarray]], posterior: list[float], epochs: int = 6, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of hashed features, fitted to soft labels by AdaGrad, in the given order."""
    w, seen, bias = np.zeros(BUCKETS + 1, dtype=np.float32), np.full(BUCKETS + 1, 1e-6, dtype=np.float32), 0.0
    for _ in range(epochs):
        for (i, v), p in zip(some, posterior, strict=True):
            z = bias + float(v @ w[i])
            g = float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) - p
            grad = g * v + decay * w[i]
            seen[i] += grad * grad
            w[i] -= rate * grad / np.sqrt(seen[i])
            bias -= 0.01 * g
    return w, bias


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, seed: str = "quality") -> tuple[Scorer, dict[str, tuple[float, float]]]:
    """The scorer and the labellers' accuracies.

    EM sees the vote pattern counts of all documents (at most 2 ** 11 counts reach the driver). The
    scorer learns the posterior from the hashed features of the whole texts of about ``rows``
    documents of least hash, fewer where these would send the driver more than about TRAIN_BYTES (a document
    sends 6 bytes for each kind of trigram, at most 6 * BUCKETS). Null texts vote but are no sample; no
    documents: weights of 0.
    """
    prepare_python(docs.sparkSession)
    code = F.pandas_udf(_as_code, "long")
    most = F.least(F.octet_length("text"), F.lit(BUCKETS + 1)).cast("long") * 6
    counts = docs.select(code("text").alias("code"), most.alias("most")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("most")).collect()
    patterns = sorted((r["code"], r["n"]) for r in counts)
    posterior, accuracy, share = estimate(patterns)
    n, sent = sum(n for _, n in patterns), sum(r["most"] or 0 for r in counts)
    rate = min(1.0, rows / max(1, n), TRAIN_BYTES / max(1, sent))

    @F.pandas_udf("code long, at binary, value binary")
    def measure(texts: pd.Series) -> pd.DataFrame:
        features = list(map(hashed, texts))
        return pd.DataFrame({"code": _as_code(texts), "at": [at.tobytes() for at, _ in features], "value": [v.tobytes() for _, v in features]})

    drawn = docs.select("text", uniform(seed, F.col("doc_id")).alias("draw")).filter(F.col("text").isNotNull() & (F.col("draw") < rate))
    measured = drawn.select("draw", measure("text").alias("m")).select("draw", "m.*").collect()
    sample = sorted((r["draw"], bytes(r["at"]), bytes(r["value"]), r["code"]) for r in measured)
    features = [(np.frombuffer(at, np.uint16), np.frombuffer(value, np.float32)) for _, at, value, _ in sample]
    return Scorer(*train(features, [posterior.get(c, share) for *_, c in sample])), accuracy


def score_quality(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add quality_score (0 to 1) and rejected (score below ``threshold``) to ``docs``.

    Null, empty or blank text: score 0, rejected. Repeated rows score alike. Clashing columns of
    ``docs`` are replaced. Whole texts are read, batch by batch, without a shuffle.
    """
    prepare_python(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("quality_score", judge(F.col(text))).withColumn("rejected", F.col("quality_score") < threshold)
