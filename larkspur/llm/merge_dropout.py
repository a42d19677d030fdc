"""SentencePiece merge-type encoding with seeded dropout, and lossless decoding.

Text is escaped as the model does (a dummy space in front, spaces as U+2581) and cut into chunks
that no piece of the model crosses. In a chunk, the agenda holds the adjacent pairs whose join is a
piece; the best score goes first, the leftmost among equals. A candidate is skipped for good if its
keyed hash (seed, document, the chunk's place and characters, its bounds) falls below the dropout rate,
so every occurrence of a word is segmented for itself. What is remembered of a chunk has no chance in
it: the merges the agenda makes without given candidates. An occurrence starts from its chunk's merges and
goes on without all those that its hash skips, until it skips none of them (a candidate whose turn never comes
cannot change the merges, so it may be left out with the others). Characters that end up without
a piece are coded as bytes, so every text decodes to itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare_python

DROPOUT = 0.1
#: An occurrence's variant, from its document and place, is one of so many.
VARIANTS = 1 << 64
#: Courses of the agenda that a task remembers; of more it keeps those in use, half as many at most.
MEMORY = 200_000
#: Occurrences that draw together.
BLOCK = 1 << 15
#: Chunks of up to so many characters (32 at most: a mask of their merges has 31 bits) go through the agenda
#: together in numpy, longer ones by heap.
TOGETHER = 32
#: Chunks that go through the agenda in step.
STEP = 1 << 13
SPACE = "▁"
_CHUNK = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MASK = (1 << 64) - 1
#: The rank of no candidate.
_NONE = np.int32(2**31 - 1)
_A, _B, _C, _D = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93


def load_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 normal, 1 byte, 2 neither) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    kinds = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
    return [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], kinds


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy, with room for ``size`` entries."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array), 1024), dtype=array.dtype)])


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, size[0] of them, then those from first[1]."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Runs:
    """A run of numbers for each node, one behind the other."""

    def __init__(self, dtype: type):
        self.data, self.used = np.zeros(0, dtype), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, node: int, data: np.ndarray, size: np.ndarray) -> None:
        """The runs of the nodes from ``node`` on."""
        stop = node + len(size)
        self.first, self.size = _roomy(self.first, stop), _roomy(self.size, stop)
        self.data = _roomy(self.data, self.used + len(data))
        self.data[self.used : self.used + len(data)] = data
        self.first[node:stop], self.size[node:stop] = self.used + np.cumsum(size) - size, size
        self.used += len(data)

    def of(self, nodes: np.ndarray) -> np.ndarray:
        return self.data[_places(self.first[nodes], self.size[nodes])]

    def keep(self, nodes: np.ndarray) -> None:
        self.data, self.size = self.of(nodes), self.size[nodes]
        self.first, self.used = np.cumsum(self.size) - self.size, len(self.data)


def _cut(text: str) -> list[str]:
    """The chunks of a text that is not empty. A U+2581 of the text itself stands alone, as an empty one, and is coded as bytes."""
    if SPACE not in text and text[0] != " " and text[-1] != " " and "  " not in text:
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    chunks = []
    for i, part in enumerate((" " + text).split(SPACE)):
        chunks += [""] * (i > 0) + _CHUNK.findall(part.replace(" ", SPACE))
    return chunks


class Codec:
    """Encoder and decoder of one model; picklable data, tables built where it is used."""

    def __init__(self, model: tuple[list[str], list[float], list[int]], dropout: float = DROPOUT, seed: int = 1):
        self.model, self.dropout, self.seed = model, dropout, seed
        self._ready = False

    def __getstate__(self) -> dict:
        return {"model": self.model, "dropout": self.dropout, "seed": self.seed, "_ready": False}

    def _prepare(self) -> None:
        pieces, scores, kinds = self.model
        n = len(pieces)
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        symbols: dict[str, int] = {}
        contents: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == 1:
                self.byte_ids[int(piece[3:-1], 16)] = i
                contents.append(bytes([int(piece[3:-1], 16)]))
            else:
                contents.append(piece.replace(SPACE, " ").encode() if kind == 0 else b"")
                if kind == 0:
                    symbols[piece] = i
        # Characters inside pieces that are no piece themselves get numbers behind the pieces.
        for piece, kind in zip(pieces, kinds, strict=True):
            if kind == 0:
                for c in piece:
                    symbols.setdefault(c, n + len(symbols))
        self.n_pieces = n
        self.symbol_of = {ord(c): i for c, i in symbols.items() if len(c) == 1}
        self.low = np.full(0x3000, -1, dtype=np.int32)
        for code, i in self.symbol_of.items():
            if code < 0x3000:
                self.low[code] = i
        pairs: dict[int, tuple[int, float]] = {}
        for piece, i in symbols.items():
            if i < n and len(piece) > 1:
                for cut in range(1, len(piece)):
                    left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                    if left is not None and right is not None:
                        pairs[left << 32 | right] = (i, scores[i])
        self.pairs = pairs
        self._lay_out()
        self.contents = np.frombuffer(b"".join(contents), dtype=np.uint8)
        self.lengths = np.array([len(c) for c in contents], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.limit = min(_MASK, int(self.dropout * 2**64))
        self._forget()
        self._ready = True

    def _lay_out(self) -> None:
        """Tables of the pairs: that of l and r, if there is one, stands at shift[l] + r, where owner is l. -1 is no symbol."""
        rank = {score: i for i, score in enumerate(sorted({score for _, score in self.pairs.values()}, reverse=True))}
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        left, right = keys >> 32, keys & 0xFFFFFFFF
        room, width = 8 * len(keys) + 1, max([self.n_pieces, *self.symbol_of.values()]) + 2
        self.shift, self.owner = np.zeros(width, np.int64), np.full(room + width, -2, dtype=np.int32)
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        sizes = np.diff(starts, append=len(keys))
        d = 0
        for i in np.argsort(-sizes, kind="stable").tolist():
            r = right[starts[i] : starts[i] + sizes[i]]
            for _ in range(100):
                if (self.owner[d + r] == -2).all():
                    break
                d = (d + 0x9E3779B1) % room
            else:  # room behind all others
                d = len(self.owner)
                self.owner = np.concatenate([self.owner, np.full(width, -2, dtype=np.int32)])
            self.shift[left[starts[i]]], self.owner[d + r] = d, left[starts[i]]
        at = self.shift[left] + right
        # The rank of each pair's score (equal scores are equal) and its piece.
        self.ranks, self.joined = np.full(len(self.owner), _NONE, dtype=np.int32), np.zeros(len(self.owner), dtype=np.int32)
        self.ranks[at] = [rank[self.pairs[k][1]] for k in keys.tolist()]
        self.joined[at] = [self.pairs[k][0] for k in keys.tolist()]

    def _forget(self) -> None:
        """Empty the memory. A node stands for a chunk and the candidates skipped in it so far."""
        self.roots: dict[str, int] = {}
        self.nodes: list[str] = []
        #: The candidates skipped, the merges made without them, and the ids that these give.
        self.without, self.merges, self.ids = _Runs(np.uint64), _Runs(np.uint64), _Runs(np.int32)
        #: The chunk's hash, and a node's key: the node before and a mask of its merges that are skipped too (-1: none).
        self.marks, self.keys = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.behind: dict[int, int] = {}
        #: How often each node was passed; older uses count half at each thinning.
        self.uses = np.zeros(0, np.int64)

    def _count(self, nodes: np.ndarray) -> None:
        self.uses = _roomy(self.uses, len(self.nodes))
        self.uses[: len(self.nodes)] += np.bincount(nodes, minlength=len(self.nodes))

    def _thin(self) -> None:
        """Keep the nodes used most. A node is passed as often as those behind it or more, so none loses its way."""
        n, least = len(self.nodes), 2
        while (self.uses[:n] >= least).sum() > MEMORY // 2:
            least *= 2
        keep = self.uses[:n] >= least
        old, new = np.flatnonzero(keep), np.cumsum(keep) - 1
        for runs in (self.without, self.merges, self.ids):
            runs.keep(old)
        self.marks, self.keys, self.uses = self.marks[old], self.keys[old], self.uses[old] // 2
        self.nodes = [self.nodes[i] for i in old.tolist()]
        self.roots = {chunk: int(new[i]) for chunk, i in self.roots.items() if keep[i]}
        behind = np.flatnonzero(self.keys >= 0)
        self.keys[behind] = new[self.keys[behind] >> 32] << 32 | self.keys[behind] & 0xFFFFFFFF
        self.behind = dict(zip(self.keys[behind].tolist(), behind.tolist(), strict=True))

    # --- one chunk at a time, by heap -------------------------------------------------------

    @staticmethod
    def _key(chunk: str, variant: int) -> int:
        return _mix((variant + _hashed(chunk)) & _MASK)

    def _spell(self, symbol: int, point: int) -> list[int]:
        """A final symbol's ids: its own, or its character's bytes."""
        if 0 <= symbol < self.n_pieces:
            return [symbol]
        return self.byte_ids[list(chr(point).encode("utf-8", "replace"))].tolist()

    def by_heap(self, chunk: str, variant: int) -> list[int]:
        """The agenda as it is written in the module's head; time n log n in the chunk's length."""
        points = [ord(c) for c in chunk]
        n, key = len(points), self._key(chunk, variant)
        symbol = [self.symbol_of.get(p, -1) for p in points]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= n or symbol[i] < 0 or symbol[j] < 0:
                return
            found = self.pairs.get(symbol[i] << 32 | symbol[j])
            if found and (not self.limit or _mix((key + i * _B + j * _C + end[j] * _D) & _MASK) >= self.limit):
                heapq.heappush(agenda, (-found[1], i, j, end[j], found[0]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while agenda:
            _, i, j, stop, joined = heapq.heappop(agenda)
            if not (alive[i] and alive[j] and after[i] == j and end[j] == stop):
                continue
            symbol[i], end[i], after[i], alive[j] = joined, stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        i = 0
        while i < n:
            out += self._spell(symbol[i], points[i])
            i = after[i]
        return out

    # --- many short chunks at a time, in step ------------------------------------------------

    def _courses(self, chunks: list[str], sizes: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The agenda of chunks of 1 to TOGETHER characters, one merge of each in a step, without the candidates in their rows of ``skipped``.

        Gives the merges' codes, chunk by chunk, and their number in each, then the ids in the same way.
        """
        n, width = len(chunks), int(sizes.max()) + 2
        # A symbol stands at its first character; before and behind each chunk stands none. Places are counted through the rows.
        alive = np.arange(width) - 1 < sizes[:, None]
        alive[:, 0] = False
        alive = alive.ravel()
        points, symbol = np.zeros(n * width, dtype=np.uint32), np.full(n * width, -1, dtype=np.int32)
        points[alive] = given = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol[alive] = self.low[np.minimum(given, 0x2FFF)]
        high = np.flatnonzero(points >= 0x3000)
        kinds, which = np.unique(points[high], return_inverse=True)
        symbol[high] = np.array([self.symbol_of.get(p, -1) for p in kinds.tolist()], dtype=np.int32)[which]
        after = np.arange(1, n * width + 1)
        before = after - 2
        ranks = np.full(n * width, _NONE, dtype=np.int32)
        table = ranks.reshape(n, width)
        zero = (np.arange(n) * width + 1).astype(np.uint64) * np.uint64((_B + _C + _D) & _MASK)
        if skipped.shape[1]:
            skipped = skipped + zero[:, None]

        def code(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
            return a.view(np.uint64) * np.uint64(_B) + b.view(np.uint64) * np.uint64(_C) + c.view(np.uint64) * np.uint64(_D)

        def offer(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> None:
            left = symbol[a]
            at = self.shift[left] + symbol[b]
            found = np.where(self.owner[at] == left, self.ranks[at], _NONE)
            if skipped.shape[1]:
                good = np.flatnonzero(found != _NONE)
                x, y = a[good], b[good]
                found[good[(skipped[r[good]] == code(x, y, after[y])[:, None]).any(axis=1)]] = _NONE
            ranks[a] = found

        a = np.flatnonzero(alive)
        offer(a, a + 1, a // width)
        rows, made = np.arange(n), []
        while True:
            at = rows * width + table[rows].argmin(axis=1)
            live = ranks[at] != _NONE
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            b = after[at]
            c = after[b]
            made.append((rows, code(at, b, c) - zero[rows]))
            symbol[at] = self.joined[self.shift[symbol[at]] + symbol[b]]
            after[at], before[c], alive[b], ranks[b] = c, at, False, _NONE
            offer(np.concatenate([at, before[at]]), np.concatenate([c, at]), np.concatenate([rows, rows]))
        # A chunk makes its merges in the first steps, one in each.
        merges = np.zeros(n, dtype=np.int64)
        for r, _ in made:
            merges[r] += 1
        first, codes = np.cumsum(merges) - merges, np.zeros(int(merges.sum()), dtype=np.uint64)
        for k, (r, x) in enumerate(made):
            codes[first[r] + k] = x
        return codes, merges, *self._spelt(symbol, points, alive, n)

    def _spelt(self, symbol: np.ndarray, points: np.ndarray, alive: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """_spell for the symbols alive of n chunks: their ids, and the number of them in each."""
        at = np.flatnonzero(alive)
        ids, sizes = symbol[at], np.ones(len(at), dtype=np.int64)
        odd = np.flatnonzero((ids < 0) | (ids >= self.n_pieces))
        if len(odd):
            p = points[at[odd]]
            sizes[odd] = np.where((p >= 0xD800) & (p < 0xE000), 1, 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000))
            coded = p.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
            ids = np.repeat(ids, sizes)
            ids[_places((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = self.byte_ids[np.frombuffer(coded, dtype=np.uint8)]
        return ids, np.bincount(at // (len(symbol) // n), weights=sizes, minlength=n).astype(np.int64)

    def _remember(self, chunks: list[str], marks: np.ndarray, keys: np.ndarray, skipped: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Make nodes; their numbers. ``skipped`` are the candidates left out, ``of`` their rows in ascending order."""
        start, n = len(self.nodes), len(chunks)
        size = np.bincount(of, minlength=n)
        first = np.cumsum(size) - size
        lengths = np.fromiter(map(len, chunks), np.int64, n)
        order = np.argsort(lengths, kind="stable")
        self.marks, self.keys = _roomy(self.marks, start + n), _roomy(self.keys, start + n)
        self.marks[start : start + n], self.keys[start : start + n] = marks[order], keys[order]
        self.nodes += [chunks[i] for i in order.tolist()]
        for i in range(0, n, STEP):
            part = order[i : i + STEP]
            few = size[part]
            without = skipped[_places(first[part], few)]
            rows = np.zeros((len(part), int(few.max())), dtype=np.uint64)  # 0 is no candidate's code
            rows[np.repeat(np.arange(len(part)), few), _places(np.zeros(len(part), np.int64), few)] = without
            codes, merges, ids, spelt = self._courses(self.nodes[start + i : start + i + len(part)], lengths[part], rows)
            self.without.add(start + i, without, few)
            self.merges.add(start + i, codes, merges)
            self.ids.add(start + i, ids, spelt)
        numbers = np.zeros(n, dtype=np.int64)
        numbers[order] = start + np.arange(n)
        return numbers

    def _root(self, chunks: list[str]) -> None:
        """Remember chunks of at most TOGETHER characters; an empty one stands for a U+2581 of the text."""
        none = np.zeros(0, np.uint64)
        if "" in chunks:
            chunks = [c for c in chunks if c]
            self.roots[""] = at = len(self.nodes)
            self.marks, self.keys = _roomy(self.marks, at + 1), _roomy(self.keys, at + 1)
            self.nodes.append("")
            self.marks[at], self.keys[at] = 0, -1
            ids = self.byte_ids[list(SPACE.encode())]
            for runs, data in ((self.without, none), (self.merges, none), (self.ids, ids)):
                runs.add(at, data, np.array([len(data)]))
        if chunks:
            n, marks = len(chunks), np.array([_hashed(c) for c in chunks], dtype=np.uint64)
            made = self._remember(chunks, marks, np.full(n, -1), none, np.zeros(0, np.int64))
            self.roots.update(zip(chunks, made.tolist(), strict=True))

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of keys, made where they are new."""
        keys, which = np.unique(keys, return_inverse=True)
        found = np.fromiter(map(self.behind.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            keys = keys[new]
            last, mask = keys >> 32, keys & 0xFFFFFFFF
            few, many = self.without.size[last], self.merges.size[last]
            of = np.repeat(np.arange(len(new)), many)
            more = mask[of] >> _places(np.zeros(len(new), np.int64), many) & 1 == 1
            of = np.concatenate([np.repeat(np.arange(len(new)), few), of[more]])
            skipped = np.concatenate([self.without.of(last), self.merges.of(last)[more]])
            order = np.argsort(of, kind="stable")
            chunks = [self.nodes[i] for i in last.tolist()]
            found[new] = self._remember(chunks, self.marks[last], keys, skipped[order], of[order])
            self.behind.update(zip(keys.tolist(), found[new].tolist(), strict=True))
        return found[which]

    def _draw(self, nodes: np.ndarray, variants: np.ndarray) -> np.ndarray:
        """The last node of each occurrence: from a chunk's own node, on without the merges that its hash skips."""
        nodes = nodes.copy()
        keys = _mixed(variants + self.marks[nodes])
        going = np.arange(len(nodes) if self.limit else 0)
        while len(going):
            node = nodes[going]
            size = self.merges.size[node]
            codes = self.merges.of(node)
            codes += np.repeat(keys[going], size)
            below = np.flatnonzero(_mixed(codes) < np.uint64(self.limit))
            stops = np.cumsum(size)
            who = np.searchsorted(stops, below, side="right")
            bits = np.int64(1) << below - (stops - size)[who]
            lead = np.flatnonzero(np.diff(who, prepend=-1))
            if not len(lead):
                break
            who = who[lead]
            going = going[who]
            nodes[going] = self._next(node[who] << 32 | np.add.reduceat(bits, lead))
            self._count(nodes[going])
        return nodes

    def _pass(self, chunks: list[str], variants: np.ndarray) -> np.ndarray:
        """The last nodes of chunks of at most TOGETHER characters."""
        nodes = np.fromiter(map(self.roots.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(nodes < 0).tolist()
        if new:
            self._root(list(dict.fromkeys(chunks[i] for i in new)))
            nodes[new] = [self.roots[chunks[i]] for i in new]
        if len(nodes):
            self._count(nodes)
        for i in range(0, len(chunks), BLOCK):
            nodes[i : i + BLOCK] = self._draw(nodes[i : i + BLOCK], variants[i : i + BLOCK])
        return nodes

    def together(self, chunks: list[str], variants: np.ndarray) -> list[np.ndarray]:
        """by_heap for many chunks of at most TOGETHER characters."""
        nodes = self._pass(chunks, variants.astype(np.uint64))
        return np.split(self.ids.of(nodes), np.cumsum(self.ids.size[nodes])[:-1])

    # --- texts ---------------------------------------------------------------------------------

    def encode(self, texts: list[str | None], keys: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; None for None, no ids for an empty text."""
        if not self._ready:
            self._prepare()
        if len(self.nodes) > MEMORY:
            self._thin()
        chunks: list[str] = []
        bounds = [0]
        for text in texts:
            chunks += _cut(text) if text else []
            bounds.append(len(chunks))
        sizes = np.diff(bounds)
        starts = np.array([_hashed(f"{self.seed}:{k}") for k in keys], dtype=np.uint64)
        places = _places(np.zeros(len(sizes), np.int64), sizes)
        variants = np.repeat(starts, sizes) + places.astype(np.uint64) * np.uint64(_A)
        long = np.flatnonzero(np.fromiter(map(len, chunks), np.int64, len(chunks)) > TOGETHER).tolist()
        spelt = [self.by_heap(chunks[i], int(variants[i])) for i in long]
        for i in long:
            chunks[i] = ""
        nodes = self._pass(chunks, variants)
        ids, stops = self.ids.of(nodes), np.concatenate([[0], np.cumsum(self.ids.size[nodes])])
        # A long chunk's ids take the place of those that stand there for it.
        pieces, edge = [], 0
        for i, own in zip(long, spelt, strict=True):
            pieces += [ids[edge : stops[i]], np.array(own, dtype=np.int32)]
            edge = stops[i + 1]
        if long:
            counts = np.diff(stops)
            counts[long] = list(map(len, spelt))
            ids, stops = np.concatenate([*pieces, ids[edge:]]), np.concatenate([[0], np.cumsum(counts)])
        return [None if t is None else ids[stops[a] : stops[b]] for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text of ids: their bytes, without the dummy space."""
        if ids is None:
            return None
        if not self._ready:
            self._prepare()
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.lengths[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.contents[at].tobytes().decode("utf-8", "replace")[1:]


def _batches(column: pa.Array, keys: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str | None], list[str]]]:
    """(first row, texts, keys) of pieces of about ``size`` characters."""
    texts, names = column.to_pylist(), ["" if k is None else str(k) for k in keys.to_pylist()]
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield at, texts[at : i + 1], names[at : i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield at, texts[at:], names[at:]


def encode_documents(docs: DataFrame, model: tuple[list[str], list[float], list[int]], dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """doc_id, ids (array<int>), lossless (whether decoding the ids gives the text) for each row.

    Null text: null ids, lossless. Empty text: no ids, lossless. A null doc_id is keyed as the empty
    text. Rows with equal doc_id and text get equal ids; dropout 0 gives the model's own encoding.
    Other columns are ignored; an empty table gives no rows. No shuffle; a task holds one batch.
    """
    prepare_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Codec(model, dropout, seed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for at, texts, keys in _batches(batch.column(1), batch.column(0)):
                ids = codec.encode(texts, keys)
                same = [codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["doc_id", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, lossless boolean")


def decode_ids(coded: DataFrame, model: tuple[list[str], list[float], list[int]], ids: str = "ids") -> DataFrame:
    """Add text, decoded from ``ids``, to ``coded``; null ids give a null text."""
    prepare_python(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(Codec(model))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.decode(x) for x in batch], dtype=object)

    return coded.withColumn("text", text_of(F.col(ids)))
