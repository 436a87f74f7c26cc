"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every code point is mapped to a class by one array lookup.  Classes with their look-ahead give the
symbols of a small automaton whose moves tell where a pre-token starts.  The automaton's state before
each symbol comes from a scan over transition functions: composition is associative, the functions
reachable by composition are few, and so composing two of them is a table lookup.  Blocks are reduced
in parallel lanes, the block results are scanned the same way, and a last pass marks the starts.  No
regular expression is used.

The slices between starts go through a bounded cache to the pair merging.  Ids are little-endian
unsigned 32-bit integers; ``offsets`` (same format) holds where the bytes of each id start in the UTF-8
text, which lets ``decode`` fill its output in one gather and cut any range of it.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import held, map_batches, type_of

# classes of code points
LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK = range(6)
# symbols: classes with what follows them
S_LETTER, S_NUMBER, S_OTHER, S_SUFFIX1, S_SUFFIX2, S_JOIN, S_BLANK_LAST, S_BLANK, S_BREAK = range(9)
# states: what the pre-token so far is
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINS_NEXT, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)

#: White space, and the letters that end a suffix such as 's or 'll.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SUFFIX1 = "stmd"
SUFFIX2 = ("re", "ve", "ll")

GROUP_CHARS = 1 << 20
CACHE_ENTRIES = 300_000
CACHED_CHARS = 64


@cache
def _code_point_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    table[0x27] = QUOTE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next_state[state, symbol] and starts[state, symbol]: does a pre-token start at this symbol?"""
    move = np.zeros((8, 9), np.uint8)
    starts = np.ones((8, 9), bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}
    for symbol, run in runs.items():
        move[:, symbol] = run
        starts[[run, JOINS_NEXT], symbol] = False
    for symbol, rest in ((S_SUFFIX1, ONE_MORE), (S_SUFFIX2, TWO_MORE)):
        move[:, symbol] = rest  # a quote that goes on a run of others, or a joined space, is no suffix
        move[[IN_OTHER, JOINS_NEXT], symbol] = IN_OTHER
        starts[[IN_OTHER, JOINS_NEXT], symbol] = False
    move[ONE_MORE, S_LETTER], move[TWO_MORE, S_LETTER] = CLOSED, ONE_MORE
    starts[[ONE_MORE, TWO_MORE], S_LETTER] = False
    move[:, S_JOIN] = JOINS_NEXT
    move[:, S_BLANK_LAST] = CLOSED
    move[:, S_BLANK] = IN_BLANKS
    starts[IN_BLANKS, S_BLANK] = False
    move[:, S_BREAK] = CLOSED
    return move, starts


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Functions over states reachable by composition: of each symbol, composed pairs, images of CLOSED, the identity."""
    move, _ = _automaton()
    known = {tuple(range(8)): 0}
    for s in range(9):
        known.setdefault(tuple(move[:, s].tolist()), len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for s in range(9):
            g = tuple(int(move[x, s]) for x in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    funcs = list(known)
    pairs = np.array([[known[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint16)
    symbols = np.array([known[tuple(move[:, s].tolist())] for s in range(9)], np.uint16)
    return symbols, pairs, np.array([f[CLOSED] for f in funcs], np.uint8), 0


def _states_before(functions: np.ndarray, lane: int = 256) -> np.ndarray:
    """Exclusive scan: the function that all symbols before each lane of ``lane`` symbols compose to."""
    _, pairs, _, identity = _monoid()
    flat, m = pairs.ravel(), len(pairs)
    lanes = -(-len(functions) // lane)
    grid = np.full(lanes * lane, identity, np.uint16)
    grid[:len(functions)] = functions
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    total = grid[0].astype(np.int32)
    for row in grid[1:]:
        total = flat[total * m + row].astype(np.int32)
    if lanes <= lane:
        before = np.empty(lanes, np.uint16)
        now = identity
        for i, f in enumerate(total.tolist()):
            before[i] = now
            now = int(pairs[now, f])
        return before
    upper = _states_before(total.astype(np.uint16), lane)  # before each group of lanes
    groups = len(upper)
    inner = np.full(groups * lane, identity, np.int32)
    inner[:lanes] = total
    inner = np.ascontiguousarray(inner.reshape(groups, lane).T)
    out = np.empty_like(inner)
    now = upper.astype(np.int32)
    for i, row in enumerate(inner):
        out[i] = now
        now = flat[now * m + row].astype(np.int32)
    return np.ascontiguousarray(out.T).ravel()[:lanes].astype(np.uint16)


def pre_token_starts(points: np.ndarray, breaks: np.ndarray, lane: int = 256) -> np.ndarray:
    """Positions in ``points`` (code points) where a pre-token starts; ``breaks`` are positions between texts."""
    n = len(points)
    kind = _code_point_classes()[points]
    kind[breaks] = 9
    blank = (kind == SPACE) | (kind == BLANK)
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~blank[1:] & (kind[1:] != 9)
    symbol = np.minimum(kind, OTHER)
    symbol[blank] = S_BLANK
    symbol[(kind == SPACE) & solid_next] = S_JOIN
    symbol[(kind == BLANK) & solid_next] = S_BLANK_LAST
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        padded[breaks] = 0
        first, second = padded[quotes + 1], padded[quotes + 2]
        symbol[quotes[np.isin(first, [ord(c) for c in SUFFIX1])]] = S_SUFFIX1
        for a, b in SUFFIX2:
            symbol[quotes[(first == ord(a)) & (second == ord(b))]] = S_SUFFIX2
    symbol[breaks] = S_BREAK

    symbols, _, closed_to, _ = _monoid()
    move, starts = _automaton()
    state = closed_to[_states_before(symbols[symbol], lane)].astype(np.int32)
    lanes = len(state)
    grid = np.full(lanes * lane, S_BREAK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    marks = np.empty((lane, lanes), bool)
    flat_move, flat_starts = move.ravel(), starts.ravel()
    for i, row in enumerate(grid):
        at = state * 9 + row
        marks[i] = flat_starts[at]
        state = flat_move[at].astype(np.int32)
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank (leftmost first) merges until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    get = ranks.get
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list: n log n for long runs without a break."""
    n = len(piece)
    part: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                joined = part[a] + part[after[a]]
                r = ranks.get(joined)
                if r is not None:
                    heapq.heappush(heap, (r, a, len(joined)))
    return [ranks[p] for p in part if p is not None]


class Encoder:
    """Encodes and decodes texts by one rank file (lines of a base64 token and its rank)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        joined = "\n" + "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        breaks = np.cumsum(np.r_[0, lengths[:-1] + 1])
        starts = pre_token_starts(points, breaks)
        first = np.searchsorted(starts, breaks).tolist() + [len(starts)]
        bounds = starts.tolist() + [len(points)]
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        cache = self.cache
        new = set(pieces).difference(cache)
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = set(pieces)
        for p in new:
            cache[p] = np.array(merge(p.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        ids = [b"".join([cache[p] for p in pieces[a + 1:b]]) for a, b in zip(first, first[1:])]
        for p in new:
            if len(p) > CACHED_CHARS:
                del cache[p]
        return ids

    def offsets(self, ids: bytes) -> bytes:
        sizes = self.sizes[np.frombuffer(ids, "<u4")]
        return (np.cumsum(sizes) - sizes).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes, first: int = 0, last: int | None = None) -> bytes:
        """Bytes of the ids from ``first`` to before ``last``."""
        n = np.frombuffer(ids, "<u4")[first:last]
        if not len(n):
            return b""
        start = np.frombuffer(offsets, "<u4")[first:last].astype(np.int64)
        start = start - start[0]
        sizes = self.sizes[n]
        total = int(start[-1] + sizes[-1])
        return self.flat[np.repeat(self.at[n] - start, sizes) + np.arange(total)].tobytes()


def _encoder(rank_file) -> Encoder:
    return held(("bpe", hash(rank_file.value)), lambda: Encoder(rank_file.value))


def grouped(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters; a longer text is a range of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def segments(text: str, limit: int = GROUP_CHARS) -> list[str]:
    """A long text cut before spaces between solid characters, where a pre-token always starts."""
    out = []
    while len(text) > limit:
        cut = text.rfind(" ", 1, limit)
        while cut > 0 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", 1, cut)
        if cut <= 0:
            break
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def _rank_bytes(df: DataFrame, rank_path: str):
    """The rank file (under a megabyte, its size does not depend on the data) for all executors."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, offsets): one row per input row, ids and byte offsets as little-endian u32 binaries.

    Null text counts as empty, which has no ids.  Repeated rows keep a row each; an empty table gives
    none; other columns are not read.  Texts longer than ``GROUP_CHARS`` are encoded in segments.
    """
    file = _rank_bytes(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(file)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in grouped(texts):
                parts = [segments(t) for t in texts[lo:hi]]
                flat = [s for p in parts for s in p]
                coded = iter([x for at, end in grouped(flat) for x in enc.encode(flat[at:end])])
                ids = [b"".join([next(coded) for _ in p]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()),
                     pa.array([enc.offsets(x) for x in ids], pa.binary())], names=["id", "ids", "offsets"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {type_of(docs, id_col)}, ids binary, offsets binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded): the UTF-8 bytes of each row's ids."""
    file = _rank_bytes(encoded, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(file)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [enc.decode(i or b"", o or b"") for i, o in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.binary())],
                                                 names=["id", "ids", "decoded"])
    rows = encoded.select(F.col(id_col).alias("id"), "ids", "offsets")
    return map_batches(rows, run, f"id {type_of(encoded, id_col)}, ids binary, decoded binary").withColumnRenamed("id", id_col)
