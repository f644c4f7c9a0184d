"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regex. Code points become symbols of a small
automaton; each symbol is a function from state to state, and since composition
of such functions is associative, the state before every code point comes from a
blocked prefix scan over the automaton's transition monoid, for a whole chunk of
texts at once. The slices between boundaries feed a pair merger whose results are
cached per Python worker. Encoding keeps each token's byte offset, so a span of
ids decodes without touching the rest.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .codepoints import LETTER, NUMBER, SPACE, chunks, class_table

# Symbols: what a code point is, with the look-ahead that the split pattern needs.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_GLUE, S_GAP, S_BLANK, S_RESET = range(9)
# States: what the token that holds the previous code point is.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_GLUE, IN_BLANKS, TAIL1, TAIL2 = range(8)

CACHE_ENTRIES = 200_000
LONG_PIECE = 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state and whether a token starts at this code point."""
    if symbol == S_RESET:
        return FREE, False
    if state == TAIL2:
        return TAIL1, False
    if state == TAIL1:
        return FREE, False
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        own = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}[symbol]
        return own, state not in (own, AFTER_GLUE)
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHERS, AFTER_GLUE):
            return IN_OTHERS, False
        return (TAIL1 if symbol == S_QUOTE1 else TAIL2), True
    if symbol == S_BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_GLUE if symbol == S_GLUE else FREE), True


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of symbols induce on states.

    Returns the composition table (first, then second), the function of each
    symbol, and whether (function so far, next symbol) starts a token, for texts
    that begin in state FREE.
    """
    gens = [tuple(_step(q, s)[0] for q in range(8)) for s in range(9)]
    index: dict[tuple[int, ...], int] = {}
    for f in [tuple(range(8)), *gens]:
        index.setdefault(f, len(index))
    queue = list(index)
    while queue:
        f = queue.pop()
        for g in gens:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(index)
                queue.append(h)
    maps = list(index)
    compose = np.array([[index[tuple(g[q] for q in f)] for g in maps] for f in maps], np.uint16)
    starts = np.array([[_step(f[FREE], s)[1] for s in range(9)] for f in maps], bool)
    assert len(maps) < 1 << 16
    return compose, np.array([index[g] for g in gens], np.uint16), starts


def _prefix_scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of f: within blocks, over block totals, then joined."""
    n = len(f)
    width = max(16, int(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = compose.ravel(), np.uint32(len(compose))
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * size + grid[j]]
    carry = grid[-1].copy()
    shift = 1
    while shift < rows:
        carry[shift:] = flat[carry[:-shift] * size + carry[shift:]]
        shift *= 2
    before = np.concatenate((np.zeros(1, np.uint16), carry[:-1]))
    return np.ascontiguousarray(flat[before[None, :] * size + grid].T).ravel()[:n]


def token_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True at each code point where a piece of the split pattern starts."""
    n = len(cp)
    if not n:
        return np.empty(0, bool)
    kind = class_table()[cp]
    row_ends = off[1:][np.diff(off) > 0]
    last = np.zeros(n, bool)
    last[row_ends - 1] = True

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[:-k] = x[k:]
        return out

    in_row1 = ~last
    in_row2 = in_row1 & ahead(in_row1, 1)
    symbol = np.full(n, S_OTHER, np.uint8)
    symbol[kind == LETTER] = S_LETTER
    symbol[kind == NUMBER] = S_NUMBER
    quote = np.flatnonzero(cp == ord("'"))
    if len(quote):
        one = np.where(in_row1[quote], ahead(cp, 1)[quote], 0)
        two = np.where(in_row2[quote], ahead(cp, 2)[quote], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quote[short]] = S_QUOTE1
        symbol[quote[pair]] = S_QUOTE2
    space = kind == SPACE
    followed = in_row1 & ~ahead(space, 1)
    symbol[space & ~followed] = S_BLANK
    symbol[space & followed] = S_GAP
    symbol[(cp == 32) & followed] = S_GLUE

    compose, gens, starts = _monoid()
    f = gens[symbol]
    first = off[:-1][np.diff(off) > 0]
    # A text's first function is composed after a reset, so the scan spans texts safely.
    f[first] = compose[gens[S_RESET], f[first]]
    state = _prefix_scan(f, compose)
    before = np.empty(n, np.uint16)
    before[0] = gens[S_RESET]
    before[1:] = state[:-1]
    before[first] = gens[S_RESET]
    return starts[before, symbol]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines ``base64-token rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Byte-pair merging of one piece: always the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    get = ranks.get
    cost = [get(a + b, none) for a, b in itertools.pairwise(parts)]
    while cost:
        best = min(cost)
        if best == none:
            break
        i = cost.index(best)
        parts[i] += parts.pop(i + 1)
        cost.pop(i)
        if i < len(cost):
            cost[i] = get(parts[i] + parts[i + 1], none)
        if i:
            cost[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple([ranks[x] for x in parts])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same result by a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return tuple([ranks[piece[i : end[i]]] for i in range(n) if alive[i]])


class PieceCache(dict):
    """Ids of each piece seen by this worker; emptied when it holds ``CACHE_ENTRIES``."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = merge_pairs(piece.encode(), self.ranks)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _cache(raw: bytes) -> PieceCache:
    return PieceCache(parse_ranks(raw))


@functools.lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> list[bytes]:
    ranks = parse_ranks(raw)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def encode_texts(column: pa.Array, raw: bytes) -> Iterator[tuple[int, int, list[list[int]]]]:
    """(start, stop, ids of each row) for the chunks of a string array."""
    cache = _cache(raw)
    for c in chunks(column):
        cut = np.flatnonzero(token_starts(c.cp, c.off))
        row_at = np.searchsorted(cut, c.off).tolist()
        cut = cut.tolist()
        cut.append(len(c.cp))
        text = c.text
        pieces = [text[a:b] for a, b in itertools.pairwise(cut)]
        ids = list(map(cache.__getitem__, pieces))
        yield (
            c.start,
            c.stop,
            [list(itertools.chain.from_iterable(ids[a:b])) for a, b in itertools.pairwise(row_at)],
        )


def read_ranks(path: str) -> bytes:
    """A rank file whole (about 1 MB, fixed by the vocabulary), to go along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _fields(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + [more])


def encode(
    df: DataFrame,
    ranks_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    offsets_col: str = "byte_offsets",
    bytes_col: str | None = None,
) -> DataFrame:
    """Append token ids and each token's start as a byte offset to every row.

    Whole texts; null and empty texts give empty arrays. Other columns and repeated
    rows pass through; columns already named like the appended ones are replaced. A
    narrow map: no shuffle, one Arrow batch at a time. With ``bytes_col`` the ids are
    decoded again in the same worker, as ``decode`` would, for a round trip that needs
    one Python process a task instead of two.
    """
    ship(df.sparkSession)
    df = df.drop(ids_col, offsets_col, *([bytes_col] if bytes_col else []))
    raw = read_ranks(ranks_path)
    names = df.columns
    added = [ids_col, offsets_col, *([bytes_col] if bytes_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(raw).__getitem__
        size = np.array([len(x) for x in _token_bytes(raw)], np.int64)
        for batch in batches:
            column = batch.column(names.index(text_col))
            for start, stop, rows in encode_texts(column, raw):
                count = np.array([len(x) for x in rows], np.int64)
                flat = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(count.sum()))
                ends = np.cumsum(size[flat])
                begins = ends - size[flat]
                first = np.concatenate(([0], np.cumsum(count)))
                base = np.concatenate(([0], ends))[first[:-1]]
                off = pa.array(first.astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(off, pa.array(flat)),
                    pa.ListArray.from_arrays(off, pa.array((begins - np.repeat(base, count)).astype(np.int32))),
                ]
                if bytes_col:
                    lists.append(pa.array([b"".join(map(token, ids)) for ids in rows], pa.binary()))
                kept = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*names, *added])

    kinds = f"`{ids_col}` array<int>, `{offsets_col}` array<int>" + (f", `{bytes_col}` binary" if bytes_col else "")
    return df.mapInArrow(run, _fields(df, kinds))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Append the bytes that each row's ids stand for (null ids: null; no ids: no bytes).

    An id that the vocabulary lacks fails the job rather than vanish. A column already
    named ``bytes_col`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop(bytes_col)
    raw = read_ranks(ranks_path)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(raw).__getitem__
        for batch in batches:
            column = batch.column(names.index(ids_col))
            first = 0
            counts = [0 if x is None else x for x in column.value_lengths().to_pylist()]
            while first < len(counts) or not len(counts):
                last, held = first, 0
                while last < len(counts) and (last == first or held + counts[last] <= 1_000_000):
                    held += counts[last]
                    last += 1
                part = column.slice(first, last - first)
                flat, at, out = part.flatten().to_pylist(), 0, []
                if flat and min(flat) < 0:
                    raise ValueError("negative token id")
                for i in range(first, last):
                    ids = flat[at : at + counts[i]]
                    at += counts[i]
                    out.append(b"".join(map(token, ids)) if part[i - first].is_valid else None)
                kept = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.binary())], names=[*names, bytes_col])
                first = last
                if not len(counts):
                    break

    return df.mapInArrow(run, _fields(df, f"`{bytes_col}` binary"))


def decode_span(ids_col: str, offsets_col: str, start, stop):
    """The ids of the tokens that overlap bytes start..stop of a row's text."""
    pairs = F.arrays_zip(F.col(ids_col).alias("i"), F.col(offsets_col).alias("o"))
    after = F.concat(F.slice(F.col(offsets_col), 2, F.greatest(F.size(offsets_col), F.lit(1))), F.array(F.lit(2**31 - 1)))
    zipped = F.zip_with(pairs, after, lambda p, e: F.struct(p["i"].alias("i"), p["o"].alias("o"), e.alias("e")))
    return F.transform(F.filter(zipped, lambda z: (z["o"] < stop) & (z["e"] > start)), lambda z: z["i"])


def digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids_col).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_col), 256).alias("decoded_sha256"),
    )
