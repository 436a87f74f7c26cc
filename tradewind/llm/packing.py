"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, closed by an end id and cut into pieces of at most ``capacity`` ids.  Pieces
are dealt to blocks of bounded size.  Every block is evolved on several islands, which are groups of one
Spark shuffle.  A crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold the same pieces twice, and puts the displaced pieces back by best fit, largest first.
After an epoch each island sends its elite to the next island of the ring; at the end each block keeps
its best island.  An island stops early when it reaches the block's lower bound, where no packing can be
better.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import grouped
from .storage import held, map_batches, ship_package, store, type_of

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
#: times that the pieces of bins below ``FULL`` are dealt to new blocks
ROUNDS = 3
FULL = 0.995
GENERATIONS = 4
POPULATION = 4
WELL_FILLED = 0.97
#: Fixed value: the pattern by which byte-level pre-tokenisers with ``use_regex`` split a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's matcher keeps a step per sign of a white-space run and fails at a million; a run that holds no whole
#: aligned block of so many signs is under twice as long.
SPACE_BLOCK = 1 << 17
#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for signs from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGN_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _rank_table(file: str) -> dict[bytes, int] | None:
    """Token bytes -> id if the tokenizer file is plain byte-level BPE whose merges stand in the order of
    their ids; then merging by lowest id is what its merges do.  None for any other file."""
    data = json.loads(file)
    model, split = data["model"], data.get("pre_tokenizer") or {}
    if (data.get("normalizer") or model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or split.get("use_regex") is False or model.get("ignore_merges") or model.get("dropout")):
        return None
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    special = {t["content"] for t in data.get("added_tokens") or ()}
    base = [t for t in vocabulary if len(t) == 1]
    if ids != sorted(set(ids)) or len(base) != 256 or len(base) + len(ids) + len(special & vocabulary.keys()) != len(vocabulary):
        return None
    return {bytes(_SIGN_BYTES[c] for c in t): i for t, i in vocabulary.items() if t not in special}


def _long_space(text: str) -> bool:
    """Whether a white-space run may be too long for tiktoken."""
    return any(text[at:at + SPACE_BLOCK].isspace() for at in range(0, len(text) - SPACE_BLOCK + 1, SPACE_BLOCK))


class _Tokens:
    """Ids of whole texts by the tokenizer file, control strings in them taken as ordinary text.

    A plain byte-level file is run by the tiktoken library on the file's own vocabulary, which gives the
    same ids in a fifth of the time; any other file, and any text with a very long white-space run, by the
    tokenizers library.
    """

    def __init__(self, file: str):
        self.file, self.coder, self.fast = file, None, None
        ranks = _rank_table(file)
        if ranks is not None:
            import tiktoken
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def library_ids(self, text: str) -> list[int]:
        if self.coder is None:
            from tokenizers import Tokenizer
            self.coder = Tokenizer.from_str(self.file)
            self.coder.encode_special_tokens = True
        return self.coder.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return self.library_ids(text) if self.fast is None or _long_space(text) else self.fast(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]


def _tokens(file) -> _Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held(("packing", hash(file.value)), lambda: _Tokens(file.value))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): the pieces of every document.

    A document longer than ``capacity`` is cut; its first piece takes what the full ones leave.  Null
    text is empty: one piece that holds the end id alone.  With ``keep_ids`` a piece carries its ids as
    little-endian u32.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # one vocabulary, its size does not depend on the data
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    fields = f"id {type_of(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokens(file)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in grouped(texts):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for i, ids in enumerate(coder.encode(texts[lo:hi]), lo):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a:4 * z]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            data.append(part)
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(data, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, fields + (", ids binary" if keep_ids else "")).withColumnRenamed("id", id_col)


class Bins:
    """Open bins by free room: the tightest bin that takes a piece is found in one look at a bit mask."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.content: list[list[int]] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, items: list[int], room: int) -> None:
        self.content.append(items)
        self._file(len(self.content) - 1, room)

    def _file(self, bin_: int, room: int) -> None:
        if room:
            self.by_room[room].append(bin_)
            self.mask |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.content[bin_].append(item)
        self._file(bin_, room - size)


def _pack(order, sizes: list[int], capacity: int, bins: list[list[int]] = ()) -> list[list[int]]:
    b = Bins(capacity)
    for items in bins:
        b.add_bin(items, capacity - sum(sizes[i] for i in items))
    for i in order:
        b.best_fit(i, sizes[i])
    return b.content


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly: full ones beside ones with much room."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of ``a`` with well-filled bins of ``b``: whole bins go in, bins that share pieces with them
    are taken apart, and the pieces they leave over are put back by best fit, largest first."""
    good = [x for x in b if sum(sizes[i] for i in x) >= WELL_FILLED * capacity]
    inject = rng.sample(good, (len(good) + 1) // 2) if good else [max(b, key=lambda x: sum(sizes[i] for i in x))]
    held = {i for x in inject for i in x}
    kept, displaced = [list(x) for x in inject], []
    least = min((sum(sizes[i] for i in x), k) for k, x in enumerate(a))[1]
    for k, x in enumerate(a):
        if k != least and held.isdisjoint(x):
            kept.append(list(x))
        else:  # also the emptiest bin is taken apart
            displaced.extend(i for i in x if i not in held)
    displaced.sort(key=lambda i: (-sizes[i], i))
    return _pack(displaced, sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]] = (),
           generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """Best bins (lists of positions in ``sizes``) that an island finds."""
    if not sizes:
        return []
    rng = random.Random(seed)
    bound = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    pool = [list(map(list, s)) for s in start]
    by_size = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))

    def score(bins):
        return _fitness(bins, sizes, capacity)

    while len(pool) < population and not (pool and min(map(len, pool)) <= bound):
        order = by_size
        if pool:  # near the order by size, so that the packings differ
            order = sorted(by_size, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0))
        pool.append(_pack(order, sizes, capacity))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= bound or len(pool) < 2:
            break
        mother, father = pool[0], pool[rng.randrange(1, len(pool))]
        pool += [crossover(mother, father, sizes, capacity, rng), crossover(father, mother, sizes, capacity, rng)]
        pool.sort(key=score, reverse=True)
        del pool[population:]
    return pool[0]


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, island = (int(k) for k in key)
        items = np.unique(group["item"].to_numpy())
        place = np.searchsorted(items, group["item"].to_numpy())
        sizes = np.empty(len(items), np.int64)
        sizes[place] = group["length"].to_numpy()
        start = []
        bins, source = group["bin"].to_numpy(), group["source"].to_numpy()
        for s in np.unique(source[bins >= 0]):
            own = source == s
            content: list[list[int]] = [[] for _ in range(int(bins[own].max()) + 1)]
            for p, b in zip(place[own].tolist(), bins[own].tolist()):
                content[b].append(p)
            start.append(content)
        best = evolve(sizes.tolist(), capacity, (epoch << 20) + block * ISLANDS + island, start)
        order = np.array([p for b in best for p in sorted(b)])
        number = np.repeat(np.arange(len(best)), [len(b) for b in best])
        length = sizes[order]
        before = np.cumsum(length) - length
        first = np.r_[True, number[1:] != number[:-1]]
        return pd.DataFrame({"block": block, "island": island, "item": items[order], "length": length, "bin": number,
                             "offset": before - np.maximum.accumulate(np.where(first, before, 0)), "n_bins": len(best), "source": 0})
    return run


_SOLUTION = "block bigint, island bigint, item bigint, length bigint, bin bigint, offset bigint, n_bins bigint, source bigint"


def _solve(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(block, bin, item, length, offset): ``items`` in ``blocks``, each as its best island packs it."""
    islands_of = items.select(F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(blocks)).alias("block"),
                              F.explode(F.array([F.lit(i).cast("bigint") for i in range(islands)])).alias("island"),
                              "item", "length", F.lit(-1).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("source"))
    now = islands_of.groupBy("block", "island").applyInPandas(_epoch(capacity, 0), _SOLUTION)
    for epoch in range(1, epochs):
        now = store(now)
        elite = now.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "item", "length", "bin",
                           F.lit(1).cast("bigint").alias("source"))
        both = now.select("block", "island", "item", "length", "bin", "source")
        both = both.unionAll(elite) if islands > 1 else both
        now = both.groupBy("block", "island").applyInPandas(_epoch(capacity, epoch), _SOLUTION)
    now = store(now)
    best = now.groupBy("block").agg(F.min(F.struct("n_bins", "island")).alias("best"))
    best = best.select("block", F.col("best.island").alias("island"))
    return now.join(best, ["block", "island"]).select("block", "bin", "item", "length", "offset")


def assign(items: DataFrame, n_items: int, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES,
           islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item: distinct longs, length: 1 to capacity).

    Blocks hold about ``block_pieces`` items whatever their documents are, so a hot document id or a
    hot length does not gather in one task.  Blocks end in bins that are not full; their pieces are dealt to
    new, fewer blocks and packed again, until one block holds them all or ``rounds`` are over.
    """
    ship_package(items.sparkSession)
    done = None
    for turn in range(rounds):
        blocks = max(1, -(-n_items // block_pieces))
        solved = _solve(items, blocks, capacity, islands, epochs, turn)
        placed = solved.select("item", "length", "offset",
                               (F.lit(turn << 58) + F.shiftleft("block", 32) + F.col("bin")).alias("sequence_id"))
        if blocks == 1 or turn == rounds - 1:
            last = placed
        else:
            placed = store(placed)
            full = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") >= FULL * capacity)
            last = placed.join(full, "sequence_id", "left_semi")
            items = store(placed.join(full, "sequence_id", "left_anti").select("item", "length"))
            n_items = items.count()
        last = last.select("item", "sequence_id", "offset")
        done = last if done is None else done.unionAll(last)
        if blocks == 1 or not n_items:
            break
    return done


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, block_pieces: int = BLOCK_PIECES,
         islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with their place: (id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Every input row is packed whole, null texts and repeated rows too; an empty table gives no rows.
    Columns beside the two named ones are not read.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids)
    # the stored table's row numbers are stable: a file split that is read again numbers its rows alike
    numbered = store(cut.withColumn("__item", F.monotonically_increasing_id()))
    items = numbered.select(F.col("__item").alias("item"), "length")
    places = assign(items, numbered.count(), capacity, block_pieces, islands, epochs, rounds).withColumnRenamed("item", "__item")
    return numbered.join(places, "__item").drop("__item")
