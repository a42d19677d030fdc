"""Byte-level BPE by a local rank file: encoding with the tiktoken library, decoding to raw bytes.

The ranks are read once on the driver and broadcast; every worker builds its encoder from them. Long
texts are cut in pieces where a match of the split pattern ends whatever stands around it, so the ids
of the pieces in a row are the ids of the whole text:

* before white space behind anything else, for white space is only ever the first of a match;
* before the last of several white spaces in front of anything else, for `\\s+(?!\\S)` ends there;
* behind an ASCII letter before an ASCII digit or mark, and behind an ASCII digit before a letter or mark.

A stretch without such a place is one piece. The library's pattern engine fails on very long runs of
white space; such a run (less its last character, if more follows) is one match, and is merged as one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare_python

#: Characters of a piece, about.
PIECE = 50_000
#: The code points with the White_Space property (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = r"!-/:-@\[-`{-~"
_SAFE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]|(?<=[{_SPACE}])[{_SPACE}](?=[^{_SPACE}])|(?<=[A-Za-z])[0-9{_MARK}]|(?<=[0-9])[A-Za-z{_MARK}]")
_BLANK = re.compile(f"[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (lines of base64 and a number)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe places into pieces of about ``size`` characters; a stretch with no such place stays whole."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        cut = found.start() if found else len(text)
        if cut - at > 2 * size:
            # A long stretch without a safe place: what stands in front of it goes first.
            for found in _SAFE.finditer(text, at + 1, at + size + 1):
                cut = found.start()
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


class Encoder:
    """Ranks and split pattern that workers share; the library's encoder is built where it is first used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, piece: int = PIECE):
        self.ranks, self.pattern, self.piece = ranks, pattern, piece
        self._encoding = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; strings that look like special tokens are ordinary text."""
        if len(text) <= self.piece:
            return np.array(self.encoding.encode_ordinary(text), dtype=np.int32)
        parts = []
        for piece in pieces(text, self.piece):
            whole = len(piece) > self.piece and _BLANK.fullmatch(piece)
            parts.append(np.array(self.encoding._encode_single_piece(piece) if whole else self.encoding.encode_ordinary(piece), dtype=np.int32))
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, piece: int = PIECE) -> DataFrame:
    """doc_id, ids (array<int>) for each row of ``docs``.

    Null text: null ids. Empty text: no ids. Ids depend on the text alone, so repeated rows agree; a null
    doc_id stays null. Other columns are ignored; an empty table gives no rows. No shuffle; a task holds
    one Arrow batch of texts and the ids of one text.
    """
    prepare_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern, piece))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at, ids in _grouped(encoder.encode(t.as_py()) if t.is_valid else None for t in batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(ids)], ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def _grouped(rows: Iterator[np.ndarray | None], most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lists as an Arrow array) of groups of about ``most`` ids."""
    held: list[np.ndarray | None] = []
    at = n = 0
    for row in rows:
        held.append(row)
        n += 0 if row is None else len(row)
        if n >= most:
            yield at, pa.array(held, pa.list_(pa.int32()))
            at, n, held = at + len(held), 0, []
    if held:
        yield at, pa.array(held, pa.list_(pa.int32()))


def decode_ids(coded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary: the tokens' bytes in a row, which need not be valid UTF-8) for each row of ``coded``.

    Null ids: null bytes. No ids: no bytes. An id that the ranks do not have, or a null among the ids, is an error. No shuffle.
    """
    prepare_python(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            texts = [None if not ids.is_valid else encoder.decode(ids.values.to_numpy(zero_copy_only=False)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")
