"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Pieces that fill a sequence are sequences of their own. The others are dealt by hash
into blocks of bounded size. Each block is solved by a few islands, each a row of a
table that holds a population of packings. Crossover injects well-filled bins of one
parent whole into the other, takes out the bins that hold an injected piece again, and
best-fits the pieces that lost their place. Between epochs every island gets its
neighbour's elite by a join. Afterwards full bins are final, and what lies in the others
is dealt anew into fewer blocks, so that room left over in one block meets pieces of
another.
"""

from __future__ import annotations

import functools
import itertools
import json
import random
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..operators.scratch import Scratch

CAPACITY = 4096
END_ID = 1
#: Pieces of a block about, islands a block, packings an island, children an epoch, epochs a level.
BLOCK_ITEMS, ISLANDS, POPULATION, CHILDREN, EPOCHS = 1024, 3, 6, 16, 2
#: A level that settles less than this share of its pieces is the last.
SETTLED = 0.05

#: Chunks of a generation kept in a Python worker, and the longest kept.
CACHE_ENTRIES, LONG_CHUNK = 500_000, 40
#: Characters from which a text is cut into chunks bit by bit; bytes of ids that leave a worker at a time.
LONG_TEXT, BATCH_BYTES = 1 << 21, 1 << 22
_GAPS, _MARKS = "\t\n\r\x0b\x0c", ".,;:!?"


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Chunks(dict):
    """Token ids of chunks, as little-endian unsigned 32-bit numbers, found when first asked for.

    A chunk is what lies between blanks, which no token of a tokenizer that drops white
    space spans, so a text's ids are those of its chunks, and most chunks were seen
    before. A new chunk of code points below 0x300, which need no normalisation but lower
    case, is split as the tokenizer splits and its words go to the tokenizer's model; any
    other goes to the whole tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.model, self.symbols = self.tokenizer.model, _byte_symbols()
        parts = json.loads(spec)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if chunk.isascii() or (max(chunk) < "\u0300" and "\u0130" not in chunk):
                low = chunk.lower()
                # Most chunks are a word, or one and a mark; the split pattern makes the same of them.
                if low.isalpha():
                    found = self.words.get(low) or self._word(low)
                elif low[:-1].isalpha() and low[-1] in _MARKS:
                    found = (self.words.get(low[:-1]) or self._word(low[:-1])) + (self.words.get(low[-1]) or self._word(low[-1]))
                else:
                    found = b"".join([self.words.get(w) or self._word(w) for w in self.split(low)])
            else:
                found = np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isalnum() else "".join([self.symbols[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(symbols)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG_CHUNK:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null and empty texts have none."""
        if not text:
            return b""
        if len(self) > CACHE_ENTRIES:
            # Two generations, so that what is in use stays when the cache is full.
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _blank(text).split(" ") if len(text) < LONG_TEXT else _cut(text)))


def _blank(text: str) -> str:
    for gap in _GAPS:
        text = text.replace(gap, " ")
    return text


def _cut(text: str) -> Iterator[str]:
    """Chunks of a very long text without a copy of it."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + LONG_TEXT)
        end = len(text) if end < 0 else end
        yield from _blank(text[at:end]).split(" ")
        at = end


@functools.lru_cache(maxsize=2)
def _chunks(spec: str) -> Chunks:
    return Chunks(spec)


def token_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, piece, start, length and ids (little-endian unsigned 32-bit, as bytes) of every row's pieces.

    A row's ids are those of its whole text, then ``end_id``; null and empty texts are the
    end alone. Only rows of more than ``capacity`` ids are cut. Strings of special tokens
    in a text are ordinary text. A narrow map: no shuffle. Repeated rows and null ids are
    rows of their own; other columns are not read.
    """
    ship(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = _chunks(spec), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, first = batch.column(1), 0
            while first < len(texts):
                rows, piece, start, length, ids, held = [], [], [], [], [], 0
                while first < len(texts) and held < BATCH_BYTES:
                    raw = chunks.encode(texts[first].as_py()) + end
                    for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                        part = raw[4 * at : 4 * (at + capacity)]
                        rows.append(first), piece.append(k), start.append(at), length.append(len(part) // 4), ids.append(part)
                    held += len(raw)
                    first += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`id` {kind}, piece int, start long, length long, ids binary"
    ).withColumnRenamed("id", id_col)


Packing = list[list[int]]


def best_fit(order: list[int], size: list[int], bins: Packing, capacity: int) -> Packing:
    """bins with the pieces of ``order``, each put where the least room is left that suffices, else in a new bin."""
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        n = size[i]
        at = bisect_left(free, (n,))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > n:
            insort(free, (room - n, k))
    return bins


def fitness(bins: Packing, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose room lies in fewer bins. Lower is better."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def cross(giver: Packing, taker: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child: well-filled bins of the giver, what is left whole of the taker, displaced pieces best-fitted."""
    fill = [sum(size[i] for i in b) for b in giver]
    middle = sorted(fill)[len(fill) // 2]
    given = [list(b) for b, f in zip(giver, fill, strict=True) if f >= middle and rng.random() < 0.5]
    taken = set(itertools.chain.from_iterable(given))
    kept, displaced = [], []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # The emptiest bins that stayed are dissolved too, else room in them would stay apart.
    kept.sort(key=lambda b: sum(size[i] for i in b))
    gone = min(len(kept), 1 + rng.randrange(3))
    for b in kept[:gone]:
        displaced += b
    displaced.sort(key=lambda i: (-size[i], i))
    return best_fit(displaced, size, given + kept[gone:], capacity)


def evolve(size: list[int], elites: list[Packing], capacity: int, children: int, seed: int) -> list[Packing]:
    """The best packings of an island, best first, after ``children`` crossings. Stops where no fewer bins are possible."""
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    order = sorted(range(len(size)), key=lambda i: (-size[i], i))
    people = [(fitness(p, size, capacity), k, p) for k, p in enumerate([*elites, best_fit(order, size, [], capacity)])]
    born = len(people)
    while len(people) < POPULATION and min(people)[0][0] > least:
        noisy = sorted(order, key=lambda i: -size[i] * rng.uniform(0.7, 1.3))
        p = best_fit(noisy, size, [], capacity)
        people.append((fitness(p, size, capacity), born, p))
        born += 1
    people = sorted(people, key=lambda x: x[:2])[:POPULATION]
    for _ in range(children):
        if people[0][0][0] <= least or len(people) < 2:
            break
        a, b = rng.sample(range(len(people)), 2)
        p = cross(people[min(a, b)][2], people[max(a, b)][2], size, capacity, rng)
        people.append((fitness(p, size, capacity), born, p))
        born += 1
        people = sorted(people, key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in people[:2]]


def _to_bins(where: np.ndarray) -> Packing:
    bins: Packing = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, b in enumerate(where.tolist()):
        bins[b].append(i)
    return bins


def _to_where(bins: Packing, n: int) -> bytes:
    where = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        where[b] = k
    return where.tobytes()


_STATE = "block long, island int, items array<long>, sizes array<int>, elites array<binary>"


def _epoch(state: DataFrame, capacity: int, children: int, seed: int, tasks: int) -> DataFrame:
    """Every island evolved by itself; bins is the number of bins of its best packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["sizes"])
                known = [_to_bins(np.frombuffer(e, np.int32)) for e in r["elites"]]
                best = evolve(r["sizes"], known, capacity, children, hash((seed, r["block"], r["island"])))
                out = r | {"elites": [_to_where(p, n) for p in best], "bins": len(best[0])}
                yield pa.RecordBatch.from_pylist(
                    [out],
                    pa.schema([("block", pa.int64()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                               ("elites", pa.list_(pa.binary())), ("bins", pa.int32())]),
                )

    return state.repartition(tasks, "block", "island").mapInArrow(run, f"{_STATE}, bins int")


def pack(pieces: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None, item_col: str = "item", size_col: str = "length") -> DataFrame:
    """item, sequence_id and offset of every piece.

    pieces: item (a unique long) and its length, 1 to ``capacity``. Sequences hold at most
    ``capacity``; offsets run from 0 without gaps, in the order of items. An empty table
    gives no rows. Blocks are bounded by ``BLOCK_ITEMS``, so neither tasks nor the driver
    hold more as the input grows; levels end once a block holds what is left or a level
    settles little more.
    """
    spark = pieces.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    rows = pieces.select(F.col(item_col).cast("long").alias("item"), F.col(size_col).cast("int").alias("size"))
    # A piece that fills a sequence is one; its id is below 0, those of packed bins are not.
    done = [rows.where(F.col("size") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), "size")]
    left = rows.where(F.col("size") < capacity)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, level = left.count(), 0
    while n:
        blocks = -(-n // BLOCK_ITEMS)
        tasks = max(1, min(max(parts, blocks * ISLANDS // 64), blocks * ISLANDS))
        block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block")
        held = left.select(block, F.struct("item", "size").alias("x")).groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x"))
        state = held.select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.transform("x", lambda x: x["item"]).alias("items"), F.transform("x", lambda x: x["size"]).alias("sizes"),
            F.array().cast("array<binary>").alias("elites"),
        )
        for epoch in range(EPOCHS):
            state = scratch.write(_epoch(state, capacity, CHILDREN, 1000 * level + epoch, tasks))
            if epoch + 1 < EPOCHS:
                guest = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("elites", 0).alias("guest"))
                state = state.join(guest, ["block", "island"]).select("block", "island", "items", "sizes", F.array_append("elites", F.col("guest")).alias("elites"))
        best = state.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("b")).select("block", F.col("b.island").alias("island"))
        chosen = state.join(best, ["block", "island"]).select("block", "items", "sizes", F.get("elites", 0).alias("best"))
        placed = scratch.write(_placed(chosen, capacity, level))
        after = placed.where(~F.col("full")).count()
        last = blocks == 1 or after > (1 - SETTLED) * n
        done.append((placed if last else placed.where("full")).select("item", "sequence_id", "size"))
        left, n, level = placed.where(~F.col("full")).select("item", "size"), 0 if last else after, level + 1
    return functools.reduce(DataFrame.union, done).transform(_offsets)


def _placed(chosen: DataFrame, capacity: int, level: int) -> DataFrame:
    """item, size, sequence_id and full (whether no piece of the block fits in besides) of the chosen packings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, where = np.array(r["sizes"], np.int32), np.frombuffer(r["best"], np.int32)
                load = np.bincount(where, weights=size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["items"], pa.int64()), pa.array(size),
                     pa.array((level << 56) + (r["block"] << 16) + where.astype(np.int64)), pa.array(capacity - load[where] < size.min())],
                    names=["item", "size", "sequence_id", "full"],
                )

    return chosen.mapInArrow(run, "item long, size int, sequence_id long, full boolean")


def _offsets(placed: DataFrame) -> DataFrame:
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("item", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if kept.

    Texts are tokenised once and written; packing reads lengths alone.
    """
    scratch = Scratch(df.sparkSession, "packing")
    tokens = token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col)
    kept = ["ids"] if keep_ids else []
    pieces = scratch.write(
        tokens.select(F.monotonically_increasing_id().alias("item"), id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *kept)
    )
    return pieces.join(pack(pieces, capacity, scratch), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes) and the ids' count of every sequence of ``pack_documents``; a group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length")).select("sequence_id", joined.alias("ids"), "length")
