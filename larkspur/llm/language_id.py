"""Language identification by compression: the language whose dictionary codes a text shortest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import median

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import broadcast_if_small, prepare_python, uniform, unused

#: The label of a text that is null or has no letter.
UNDETERMINED = "und"
#: The fit reads about so many pieces of a language's texts (bounded sample): a text is cut into pieces of PIECE
#: characters, a shorter one is one piece. All languages together give about MOST pieces, or LEAST each.
DOCS = 400
PIECE = 4096
MOST, LEAST = 8_000, 20
#: One text in so many of the sample is no part of the dictionary but says what it saves.
CHECKED = 8
#: Texts are coded whole, in blocks of so many bytes, so that a dictionary matters as much at the
#: end of a long text as at its start.
BLOCK = 4096
LEVEL = 6
#: A prediction is rejected if the second-best code is less than so much longer (a share of it), by plain code
#: lengths or by those divided by what is usual: texts of a few words are coded alike by all dictionaries.
MARGIN = 0.01
#: The margin at which the score is about 0.76 (tanh 1).
SCALE = 0.05
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == rest


def fit(labelled: DataFrame, docs: int = DOCS, seed: str = "lid", most: int = MOST) -> Classifier:
    """The classifier from (doc_id, text, lang) rows.

    A language's sample are the pieces of its texts whose hash is below docs / pieces, from any place of a text.
    Pieces are counted by language (folded on the map side) and drawn where the texts are, so no language's
    rows ever meet in one task, and what reaches the driver is about ``docs`` pieces of a language, of ``most``
    in all (LEAST of each where languages are many), whatever the texts' lengths. Null and empty texts and
    null languages take no part; repeated rows are drawn together; no rows: no languages.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & (F.col("text") != "")).select("doc_id", "text", "lang")
    last = F.floor((F.char_length("text") - 1) / PIECE).cast("int")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(last + 1).alias("pieces")).collect()
    rows_of, each = {r["lang"]: r["n"] for r in counts}, min(docs, max(LEAST, most / max(1, len(counts))))
    rates = broadcast_if_small(labelled.sparkSession.createDataFrame([(r["lang"], each / r["pieces"]) for r in counts], "lang string, rate double"))

    def draw(i: Column) -> Column:
        return uniform(seed, F.col("doc_id"), i)

    places = F.filter(F.sequence(F.lit(0), last), lambda i: draw(i) < F.col("rate"))
    pieces = F.transform(places, lambda i: F.struct(draw(i).alias("draw"), F.col("text").substr(i * PIECE + 1, F.lit(PIECE)).alias("piece")))
    drawn = rows.join(rates, "lang").select("lang", F.explode(pieces).alias("p")).select("lang", "p.*")
    found: dict[str, list[tuple[float, str]]] = {}
    for r in drawn.collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["piece"]))
    return Classifier.of({lang: [t for _, t in sorted(found[lang])] for lang in sorted(found, key=lambda x: (-rows_of[x], x))})


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _code(coder: zstandard.ZstdCompressor, data: bytes) -> int:
    return sum(len(coder.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK))


class Classifier:
    """Codes texts with each language's dictionary; picklable, so tasks build their own coders.

    usual: the share of its bytes that a text of the language usually takes when coded with the
    language's own dictionary. Code lengths are divided by it, so that neither a larger dictionary
    nor a language that is easily coded wins by that.
    """

    def __init__(self, dictionaries: dict[str, bytes], usual: dict[str, float] | None = None):
        self.dictionaries, self.usual = dictionaries, usual or {}
        self._coders: list[tuple[str, float, zstandard.ZstdCompressor]] | None = None

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> Classifier:
        """From texts by language. One text in CHECKED is left out of the dictionary, and the median
        of their coded shares is the usual one; a language with too few texts for that puts all into its
        dictionary and takes the mean of the other languages' shares (1, if there is none)."""
        dictionaries, usual = {}, {}
        for lang, texts in samples.items():
            enough = len(texts) >= 2 * CHECKED
            dictionaries[lang] = b"\n".join(_bytes(t) for i, t in enumerate(texts) if i % CHECKED or not enough)
            if enough:
                coder = _coder(dictionaries[lang])
                usual[lang] = median(_code(coder, _bytes(t)) / len(_bytes(t)) for t in texts[::CHECKED])
        mean = sum(usual.values()) / len(usual) if usual else 1.0
        return cls(dictionaries, {lang: usual.get(lang, mean) for lang in dictionaries})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None}

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        if self._coders is None:
            self._coders = [(lang, self.usual.get(lang, 1.0), _coder(content)) for lang, content in self.dictionaries.items()]
        data = _bytes(text)
        sizes = sorted(((size / usual, size, lang) for lang, usual, size in ((lang, usual, _code(coder, data)) for lang, usual, coder in self._coders)), key=lambda x: x[0])
        best, plain, lang = sizes[0]
        if len(sizes) == 1:
            return lang, 1.0, False
        other = min(size for _, size, _ in sizes[1:])
        margin = max(0.0, min((sizes[1][0] - best) / sizes[1][0], (other - plain) / other))
        return lang, math.tanh(margin / SCALE), margin < MARGIN


def identify(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1: the margin of the shortest code, the lesser of the scaled and the plain one) and rejected to ``docs``.

    A null text, an empty one and one without a letter: ``und``, score 0, rejected. Ties: the
    language with more rows in the fit, score 0, rejected. No languages: every row ``und``. Columns of
    ``docs`` with these names are replaced, all others stay. Texts are coded whole, batch by batch, without a shuffle.
    """
    prepare_python(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.value.classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    (lid,) = unused(docs, "lid")
    judged = docs.withColumn(lid, judge(F.col(text)))
    return judged.withColumns({n: F.col(lid)[n] for n in ("lang_pred", "score", "rejected")}).drop(lid)
