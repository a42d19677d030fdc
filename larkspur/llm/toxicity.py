"""Toxicity: a learned lexicon, matched with misspellings by Levenshtein automata over its trie.

The lexicon is a trie; the automata of all its terms are run over it at once, as one deterministic
automaton whose states are sets of (trie node, edits) and which is built lazily from the words that
occur. Windows around each match tell quotation from abuse; a logistic model scores the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import broadcast_if_small, durable, prepare_python, uniform

#: The fit reads about so many labelled rows (those of least hash; bounded sample). Terms and near words are all
#: that pass the tests on them.
FIT_ROWS = 20_000
#: A prefix that is a term by itself has so many letters.
PREFIX = (4, 8)
#: A term must be so much likelier in toxic documents, and its G statistic must stand at this level
#: after dividing it by the number of candidates.
LIFT, LEVEL = 5.0, 0.5
#: Edits allowed for terms of at least so many letters.
EDITS = ((9, 2), (5, 1))
#: Characters on either side of a match that are searched for quotation marks and reporting words.
CONTEXT = 60
THRESHOLD = 0.3
#: Words and states of the automaton that a task remembers before it starts anew.
MEMORY, STATES = 400_000, 60_000
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
# Reporting words of four languages.
REPORTING = frozenset("said says quoted quote wrote called calling reported alleged dit cité appelé disait sagte zitat genannt schrieb dijo cita llamado escribió".split())
FEATURES = ("exact", "misspelt", "prefixed", "quoted", "share", "one")


#: Prior means of the weights: what little data does not overrule. None but the last goes below 0.
PRIOR = (4.0, 3.0, 1.5, 0.5, 1.0, -3.0)


def allowed_edits(terms: list[str], doubtful: frozenset[str] = frozenset()) -> dict[str, int]:
    """Edits for each term: by its length, none for a doubtful one."""
    return {t: 0 if t in doubtful else next((k for n, k in EDITS if len(t) >= n), 0) for t in terms}


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, determinised as words need it."""

    def __init__(self, terms: list[str], doubtful: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.limit = [0]
        self.best = [-1]
        self.term: dict[int, str] = {}
        for term, k in allowed_edits(terms, doubtful).items():
            node = 0
            self.limit[0] = max(self.limit[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.best.append(-1)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], k)
            self.best[node] = k
            self.term[node] = term
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a state; -1 for the empty one. A missing letter costs an edit and no input."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.limit[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(min((e for node, e in key if e <= self.best[node]), default=-1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            pairs.add((node, e + 1))
            for label, child in self.children[node].items():
                pairs.add((child, e if label == c else e + 1))
        self.moves[state][c] = to = self._state(pairs)
        return to

    def _run(self, word: str) -> int:
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return -1
        return state

    def edits(self, word: str) -> int:
        """The least number of edits to a term that allows them, or -1."""
        state = self._run(word)
        return -1 if state < 0 else self.accepts[state]

    def near(self, word: str) -> list[str]:
        """The terms that allow the edits to the word."""
        state = self._run(word)
        return [] if state < 0 else [self.term[node] for node, e in self.sets[state] if e <= self.best[node]]


class Model:
    """Terms, prefixes and logistic weights; picklable: each task builds its automaton anew."""

    def __init__(self, terms: list[str], prefixes: list[str], weights: list[float] | None = None, innocent: list[str] | None = None, doubtful: list[str] | None = None, guilty: list[str] | None = None):
        self.terms, self.prefixes, self.weights = sorted(terms), sorted(prefixes), weights or list(PRIOR)
        self.innocent, self.doubtful, self.guilty = (frozenset(x or ()) for x in (innocent, doubtful, guilty))
        self._automaton: Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_stems": None, "_known": None}

    def _kind(self, word: str) -> str:
        """"exact", "misspelt", "prefixed" or ""; the answer is remembered."""
        if self._automaton is None:
            self._automaton, self._stems, self._known = Automaton(self.terms, self.doubtful), frozenset(self.prefixes), {}
        kind = self._known.get(word)
        if kind is None:
            e = self._automaton.edits(word)
            if e == 0:
                kind = "exact"
            elif any(word[:n] in self._stems for n in range(PREFIX[0], min(PREFIX[1], len(word)) + 1)):
                kind = "prefixed"
            else:
                kind = "misspelt" if word in self.guilty or e > 0 and word not in self.innocent else ""
            self._known[word] = kind
        return kind

    def tally(self, text: str | None) -> tuple[int, dict[str, int], dict[str, list[int]]]:
        """Words in a text; its matches by kind; and of each misspelt word how often it is used and how often only quoted."""
        if self._automaton is not None and len(self._known) > MEMORY:
            self._known = {}
        low = (text or "").lower()
        words = _WORD.findall(low)
        found = {w: k for w in set(words) if (k := self._kind(w))}
        counts, near = dict.fromkeys(("exact", "prefixed", "quoted"), 0), {}
        if found:
            at = straight = 0
            for m in _WORD.finditer(low):
                kind = found.get(m[0])
                if not kind:
                    continue
                # Straight marks on the line before the match, counted once along the text.
                line = low.rfind("\n", at, m.start())
                straight = low.count('"', line + 1, m.start()) if line >= 0 else straight + low.count('"', at, m.start())
                at = m.start()
                mark = quoted(low, m.start(), m.end(), straight)
                if kind == "misspelt":
                    near.setdefault(m[0], [0, 0])[mark] += 1
                else:
                    counts["quoted" if mark else kind] += 1
        return len(words), counts, near

    def features_of(self, n_words: int, counts: dict[str, int], near: dict[str, list[int]]) -> list[float]:
        """Counts of matches by kind (log1p), their share of the words, and 1, from a tally of this model or of one without judged near words."""
        some = {"exact": counts["exact"], "misspelt": 0, "prefixed": counts["prefixed"], "quoted": counts["quoted"]}
        for word, (used, quoted_only) in near.items():
            if self._kind(word):
                some["misspelt"] += used
                some["quoted"] += quoted_only
        hits = some["exact"] + some["misspelt"] + some["prefixed"]
        return [math.log1p(some[k]) for k in FEATURES[:4]] + [min(1.0, 20 * hits / max(1, n_words)), 1.0]

    def features(self, text: str | None) -> list[float]:
        return self.features_of(*self.tally(text))

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quoted(text: str, start: int, end: int, straight: int, context: int = CONTEXT) -> bool:
    """Whether the window around text[start:end] makes it a quotation: marks on both sides with none
    between, or a reporting word before it and a mark at it. straight: the straight marks before it on its line."""
    before, after = text[max(0, start - context) : start], text[end : end + context]
    opened = max(map(before.rfind, _OPEN))
    if opened < 0:
        return False
    # A straight mark opens if an odd number of them stands before.
    if before[opened] == '"' and straight % 2 == 0:
        return False
    closed = min((i for i in map(after.find, _CLOSE) if i >= 0), default=-1)
    near = "\n" not in before[opened:] and len(before) - opened <= context
    return near and (closed >= 0 and "\n" not in after[:closed] or bool(REPORTING & set(_WORD.findall(before[:opened])[-4:])))


def learn_terms(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and prefixes that mark toxic documents, from (text, toxic) rows.

    Document counts of words and prefixes are aggregated in Spark; only terms that pass the test reach
    the driver, fewer than the distinct words of the sample's toxic rows.
    """
    rows = labelled.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))).alias("words"))
    lengths = F.sequence(F.lit(PREFIX[0]), F.lit(PREFIX[1]))
    stems = F.flatten(F.transform("words", lambda w: F.transform(F.filter(lengths, lambda n: n < F.length(w)), lambda n: F.concat(F.substring(w, 1, n), F.lit("*")))))
    terms = rows.select("toxic", F.explode(F.array_distinct(F.concat(F.filter("words", lambda w: F.length(w) >= 3), stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).filter("t >= 3")
    counts = durable(counts)
    total = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    bad, every = int(total["t"] or 0), int(total["n"])
    if not bad or bad == every:
        return [], []
    t, c = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    expected = F.col("n") * (bad / every)
    g = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (F.col("n") - expected))).otherwise(0.0))
    lift = (t / bad) / ((c + 0.5) / (every - bad))
    # 27.6 at one candidate in a million: the chi-square tail exp(-g / 2) is below LEVEL / candidates.
    candidates = max(1, counts.count())
    chosen = counts.filter((lift >= LIFT) & (g > 2 * math.log(candidates / LEVEL))).withColumn("g", g).orderBy(F.desc("g"), "term").collect()
    words = {r["term"] for r in chosen if r["term"][-1] != "*"}
    stems = {r["term"][:-1]: r["n"] for r in chosen if r["term"][-1] == "*"}
    # A prefix that only repeats one term, or a shorter prefix, adds nothing.
    whole = {r["term"]: r["n"] for r in chosen}
    stems = {s: n for s, n in stems.items() if n > 1.3 * max((whole[w] for w in words if w.startswith(s)), default=0)}
    stems = [s for s, n in stems.items() if not any(s[:i] in stems and stems[s[:i]] < 1.5 * n for i in range(PREFIX[0], len(s)))]
    return sorted(words), sorted(stems)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> list[float]:
    """Logistic regression by Newton's method with a ridge towards PRIOR; weights of matches stay at 0 or above."""
    prior = np.array(PRIOR)
    w = prior.copy()
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    return w.tolist()


def judge_near_words(seen: list[tuple[str, int, int]], terms: list[str], bad: int, clean: int) -> dict[str, list[str]]:
    """What the near words of the sample, as (word, toxic documents, clean documents), tell of near words.

    Innocent: used by clean documents, and not LIFT times likelier in toxic ones. Doubtful: terms whose
    near words with one document (an unseen word is like these) are at least as usual in clean documents;
    near words of theirs count only if they are guilty: in two toxic documents or more, LIFT times likelier.
    """
    automaton, once = Automaton(terms), {}
    for word, t, c in seen:
        if t + c == 1:
            for term in automaton.near(word):
                found = once.setdefault(term, [0, 0])
                found[0] += t
                found[1] += c
    likelier = {w for w, t, c in seen if t * clean >= LIFT * (c + 0.5) * bad}
    return {
        "innocent": sorted(w for w, _, c in seen if c and w not in likelier),
        "doubtful": sorted(term for term, (t, c) in once.items() if c and c * bad >= t * clean),
        "guilty": sorted(w for w, t, _ in seen if t >= 2 and w in likelier),
    }


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: str = "toxic") -> Model:
    """The model from (doc_id, text) rows and (doc_id, toxic) labels; rows without a label are left out.

    The sample is drawn among the labels, by a hash of the id; only its texts are read into the fit,
    and they are written to the checkpoint folder once. Of each sampled document its counts and near
    words reach the driver. No labels: no terms.
    """
    prepare_python(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = known.filter(uniform(seed, F.col("doc_id")) < min(1.0, rows / max(1, known.count())))
    sample = durable(docs.select("doc_id", "text").join(broadcast_if_small(drawn), "doc_id"))
    terms, prefixes = learn_terms(sample)
    # One pass tells the matches and the near words; whether these count is decided by their use in all documents.
    first = docs.sparkSession.sparkContext.broadcast(Model(terms, prefixes))

    @F.pandas_udf("n long, exact long, prefixed long, quoted long, near array<struct<word:string,used:long,quoted:long>>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, *(c[k] for k in ("exact", "prefixed", "quoted")), [{"word": w, "used": u, "quoted": q} for w, (u, q) in sorted(near.items())]) for n, c, near in map(first.value.tally, texts)]
        return pd.DataFrame(rows, columns=["n", "exact", "prefixed", "quoted", "near"])

    tallies = durable(sample.select("doc_id", "toxic", measure("text").alias("m")).select("doc_id", "toxic", "m.*"))
    used = tallies.select("toxic", F.explode(F.filter("near", lambda x: x["used"] > 0)).alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    seen = sorted((r["word"], r["t"], r["n"] - r["t"]) for r in used.collect())
    found = sorted(tallies.select("toxic", "n", "exact", "prefixed", "quoted", "near", "doc_id").collect(), key=str)
    bad = sum(r["toxic"] for r in found)
    model = Model(terms, prefixes, **judge_near_words(seen, terms, bad, len(found) - bad))
    if found:
        x = [model.features_of(r["n"], r.asDict(), {w["word"]: [w["used"], w["quoted"]] for w in r["near"]}) for r in found]
        model.weights = fit_weights(np.array(x), np.array([r["toxic"] for r in found], dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold, else 0) to ``docs``.

    Null and empty texts score as texts without a match. Repeated rows score alike. Clashing columns
    are replaced. Whole texts are read, batch by batch, without a shuffle.
    """
    prepare_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", judge(F.col(text))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
