"""Best-fit packing of token pieces into fixed-length sequences by bin completion.

1. A pass over the texts (Arrow batches) makes pieces of at most ``capacity``
   tokens and numbers those of equal length within its task.
2. The histogram of piece lengths, at most ``capacity`` numbers whatever the
   corpus holds, is planned as one cutting-stock instance: branch and bound
   over undominated fillings around the largest length left, best-fit plan as
   the first incumbent, waste bound against the best plan so far.  A filling
   is used as often as the counts allow (half as often, a quarter and so on
   are branches of their own), so the plan has some thousand patterns at any
   size.
3. A pattern's places for a length are ranges of that length's rank.  Ranks
   come from per-task counts, so neither a hot length nor the corpus is ever
   in one task, and each piece finds its place by its rank.

Cases: null or empty text is the end token alone; repeated rows and null ids
are documents of their own; a table without rows gives none; a very long text
is tokenized a megabyte at a time; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .text import SPACED, lower_ascii, slices, texts_of, word_bounds, word_hashes

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 600_000
CHUNK = 2 << 20
NODES = 4_000
WIDTH = 4
_ID = 4  # bytes of a token id

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, a word at a time, as little-endian 32-bit bytes.

    The tokenizer ends a token at every space and between a letter and a full
    stop or the like, and knows lower case only.  So a text is lower-cased
    and cut there, its words are encoded once (many in one call, with the end
    token between them) and kept, up to ``CACHE_WORDS`` in a worker.  Texts
    or words that spell out a special token go to the tokenizer as they are.
    :meth:`encode_many` finds the words of many texts by their 64-bit hashes
    and puts the ids together by offsets.
    """

    FENCE = "<|endoftext|>"
    MARK = b"<|"
    PER_CALL = 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.fence = self.tokenizer.token_to_id(self.FENCE)
        self.known: dict[bytes, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.hash = np.empty(0, dtype=np.uint64)
        self.at = self.size = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype="<u4")

    @staticmethod
    def words(raw: bytes) -> list[bytes]:
        if WordEncoder.MARK in raw:
            return raw.split()
        return _STOP.sub(rb" \1", raw.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        plain = sorted(w for w in new if self.MARK not in w)
        for w in new:
            if self.MARK in w:
                ids = self.tokenizer.encode(w.decode(), add_special_tokens=False).ids
                self.known[w] = b"".join(i.to_bytes(_ID, "little") for i in ids)
        if plain:
            raw = np.frombuffer(b"".join(plain), np.uint8)
            ends = np.cumsum([len(w) for w in plain])
            size, ids = self._new(raw, np.concatenate([[0], ends[:-1]]), ends)
            packed, upto = ids.tobytes(), (np.cumsum(size) * _ID).tolist()
            for w, lo, hi in zip(plain, [0, *upto[:-1]], upto, strict=True):
                self.known[w] = packed[lo:hi]

    def _new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these words has, and all of them one after another."""
        words = slices(raw, starts, ends).to_pylist()
        fence = f" {self.FENCE} "
        sizes, coded = [], []
        for at in range(0, len(words), 64 * self.PER_CALL):  # few encodings are held at a time
            part = words[at:at + 64 * self.PER_CALL]
            groups = [fence.join(part[k:k + self.PER_CALL]) for k in range(0, len(part), self.PER_CALL)]
            done = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
            ids = np.concatenate([np.array([*e.ids, self.fence], dtype="<u4") for e in done])
            sizes.append(np.diff(np.flatnonzero(ids == self.fence), prepend=-1) - 1)
            coded.append(ids[ids != self.fence])
        return np.concatenate(sizes), np.concatenate(coded)

    def _slots(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the words of these distinct hashes are kept; unknown ones are encoded first."""
        at = np.searchsorted(self.hash, hashes)
        new = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(self.hash) + len(new) > CACHE_WORDS:
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            new = new[np.argsort(hashes[new])]
            size, ids = self._new(raw, starts[new], ends[new])
            both = np.concatenate([self.hash, hashes[new]])
            order = np.argsort(both, kind="stable")
            self.hash = both[order]
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.hash, hashes)

    def encode_many(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without special tokens' spellings) one after another, and where each text's begin (and the last's end)."""
        gap = np.array([0x0A], np.uint8)
        raw = lower_ascii(np.concatenate([x for t in texts for x in (t, gap)]))
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        starts, ends = word_bounds(raw, SPACED)
        stop = _STOPS[raw]
        cut = np.flatnonzero(stop[1:] & _LETTERS[raw[:-1]]) + 1
        rest = np.flatnonzero(~stop)
        cut = cut[~SPACED[raw[rest[np.searchsorted(rest, cut)]]]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        if not len(starts):
            return self.ids[:0], np.zeros(len(texts) + 1, dtype=np.int64)
        number, hashes = pd.factorize(word_hashes(raw, starts, ends))
        first = np.empty(len(hashes), dtype=np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        kept = self._slots(hashes, raw, starts[first], ends[first])
        size = self.size[kept][number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[kept][number] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, begin)]

    def encode(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # the words kept were given up for others meanwhile
            self.learn(set(words))
            return b"".join(map(self.known.__getitem__, words))


#: Stops at the end of a word, after a letter.
_STOP = re.compile(rb"(?<=[a-z])([.,;:!?]+)(?=[\x20\x09-\x0D])")
_STOPS, _LETTERS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOPS[[*b".,;:!?"]] = True
_LETTERS[97:123] = True
#: One encoder a Python worker, kept between its tasks.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _spans(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at spaces only."""
    at = 0
    while len(raw) - at > size:
        m = re.compile(rb"[\x20\x09-\x0D]").search(raw, at + size)
        if not m:
            break
        yield raw[at:m.start()]
        at = m.end()
    yield raw[at:] if at else raw


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: number, start, length and checksum (and ids) of its tokens.

    ``part`` and ``nth`` number the pieces of equal length within a task; the
    result must be written before it is used (see :func:`pack`).
    """
    path = tokenizer or default_tokenizer()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
              ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    end = end_id.to_bytes(_ID, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        width, rows = capacity * _ID, []

        def row(doc, n: int, ids: bytes) -> None:
            k = len(ids) // _ID
            nth = seen.get(k, 0)
            seen[k] = nth + 1
            rows.append((doc, n, n * capacity, k, zlib.crc32(ids), part, nth,
                         *([list(memoryview(ids).cast("i"))] if with_ids else ())))

        def out() -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def long(doc, raw: bytes) -> None:
            n, ids = 0, b""
            for span in _spans(raw):
                some = coder.words(span)
                coder.learn(set(some))
                ids += coder.encode(some)
                while len(ids) > width:
                    row(doc, n, ids[:width])
                    n, ids = n + 1, ids[width:]
            for k in range(0, len(ids) + _ID, width):
                row(doc, n, (ids + end)[k:k + width])
                n += 1

        for b in batches:
            left = zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True)
            while True:
                docs_here, texts, size = [], [], 0
                for doc, raw in left:  # a few megabytes of text at a time
                    size += len(raw)
                    if len(raw) > 1 << 21 or (raw[:-1][raw[1:] == 0x7C] == 0x3C).any():
                        long(doc, raw.tobytes())
                    else:
                        docs_here.append(doc)
                        texts.append(raw)
                    if size >= CHUNK:
                        break
                if not size and not docs_here:
                    break
                if texts:
                    ids, bounds = coder.encode_many(texts)
                    bounds = bounds.tolist()
                    for doc, lo, hi in zip(docs_here, bounds[:-1], bounds[1:], strict=True):
                        for n, at in enumerate(range(lo, hi + 1, capacity)):
                            some = ids[at:min(at + capacity, hi)].tobytes()
                            row(doc, n, some + end if hi - at < capacity else some)
                if len(rows) >= 5000 or with_ids and rows:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


# -- planning on the histogram ------------------------------------------------

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), times


def _best_fit(room: int, counts: dict[int, int], order: list[int], skip: int = 0) -> list[tuple[int, int]]:
    """Fill ``room`` with the largest length that fits, again and again; ``skip`` leaves out that many first choices."""
    out = []
    for x in order:
        if room <= 0:
            break
        n = min(counts.get(x, 0), room // x)
        if n and skip:
            skip -= 1
            continue
        if n:
            out.append((x, n))
            room -= n * x
    return out


def _fillings(room: int, counts: dict[int, int], order: list[int], width: int) -> list[list[tuple[int, int]]]:
    """A few undominated fillings of ``room``, least waste first.

    Best fit, best fit around each of the next largest choices, and the pairs
    that fill the room without a rest.  A filling is dropped if a larger
    length could stand for one of its own (dominance).
    """
    found: dict[tuple, list[tuple[int, int]]] = {}
    for skip in range(width):
        f = _best_fit(room, counts, order, skip)
        found[tuple(f)] = f
    pairs = 0
    for x in order:  # exact pairs
        y = room - x
        if y < 0 or y > x:
            continue
        if (y == 0 or counts.get(y, 0)) and counts.get(x, 0) >= 1 + (x == y):
            f = [(x, 2)] if x == y else [(x, 1)] + ([(y, 1)] if y else [])
            found[tuple(f)] = f
            pairs += 1
            if pairs >= width:
                break
    out = []
    for f in found.values():
        rest = room - sum(x * n for x, n in f)
        used = dict(f)
        if not any(counts.get(y, 0) > used.get(y, 0) for x, _ in f for y in range(x + 1, x + rest + 1)) and \
                not any(counts.get(y, 0) > used.get(y, 0) for y in range(1, rest + 1)):
            out.append((rest, [-x for x, _ in f], f))
    out.sort(key=lambda t: t[:2])
    return [f for _, _, f in out[:width]]


def _undominated(room: int, counts: dict[int, int], order: list[int]) -> Iterator[list[tuple[int, int]] | None]:
    """All undominated fillings of ``room`` in turn, larger lengths first; None for each that is dominated."""
    def more(at: int, rest: int, items: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]] | None]:
        used = dict(items)
        full = not any(counts.get(y, 0) > used.get(y, 0) for y in range(1, rest + 1))
        if full:
            dominated = any(counts.get(y, 0) > used.get(y, 0) for x, _ in items for y in range(x + 1, x + rest + 1))
            yield None if dominated else list(items)
            return
        yield None
        for i in range(at, len(order)):
            x = order[i]
            for n in range(min(counts.get(x, 0), rest // x), 0, -1):
                yield from more(i + 1, rest - n * x, [*items, (x, n)])

    yield from more(0, room, [])


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[Pattern]:
    """Patterns that hold all pieces in as few bins as found.

    Descents over the fillings around the largest length left; the choices
    left open on the way, of pruned descents too, are taken up from the last
    and the first in turn.  A branch ends when its waste exceeds what a plan
    one bin better than the incumbent may waste; the search ends at the lower
    bound, when no choice is open, or after ``nodes`` nodes.
    The first descent is the best-fit incumbent; the number of nodes bounds
    the search only, every piece is placed by any plan.
    """
    total = sum(k * n for k, n in histogram.items())
    bound = max(-(-total // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))

    def bins_of(p: list[Pattern]) -> int:
        return sum(t for _, t in p)

    def waste_of(p: list[Pattern]) -> int:
        return sum((capacity - sum(x * n for x, n in items)) * t for items, t in p)

    def descend(first: bool, start: list[Pattern], counts: dict[int, int], allowed: float) -> tuple[list[Pattern], bool, list[int]]:
        """One plan, whether it came to its end, and the places at which other fillings could be chosen."""
        plan, open_, counts = list(start), [], dict(counts)
        order = sorted((k for k, n in counts.items() if n), reverse=True)
        waste = waste_of(plan)
        while order:
            if not counts[order[0]]:
                order.pop(0)
                continue
            big = order[0]
            counts[big] -= 1
            f = _best_fit(capacity - big, counts, order) if first else \
                (_fillings(capacity - big, counts, order, width) or [_best_fit(capacity - big, counts, order)])[0]
            counts[big] += 1
            open_.append(len(plan))
            pattern, times = widest(big, f, counts)
            for x, n in pattern:
                counts[x] -= n * times
            last = not any(counts[x] for x in order)
            plan.append((pattern, times))
            waste += (capacity - sum(x * n for x, n in pattern)) * times
            if waste > allowed and not last:
                return plan, False, open_
            order = [x for x in order if counts[x]] if len(plan) % 16 == 0 or last else order
        return plan, True, open_

    def widest(big: int, f: list[tuple[int, int]], counts: dict[int, int]) -> tuple[tuple[tuple[int, int], ...], int]:
        """The filling with ``big`` as a pattern, and how often the counts allow it."""
        items = {big: 1}
        for x, n in f:
            items[x] = items.get(x, 0) + n
        return tuple(sorted(items.items(), reverse=True)), min(counts[x] // n for x, n in items.items())

    def others(start: list[Pattern], taken: Pattern) -> Iterator[tuple[Pattern, dict[int, int]] | None]:
        """The choices but ``taken`` after ``start``, with the counts they leave; None for a step without one."""
        counts = dict(histogram)
        for items, t in start:
            for x, n in items:
                counts[x] -= n * t
        order = sorted((k for k, n in counts.items() if n), reverse=True)
        big = order[0]
        inside = {**counts, big: counts[big] - 1}

        def choice(pattern: tuple[tuple[int, int], ...], times: int) -> tuple[Pattern, dict[int, int]]:
            left = dict(counts)
            for x, n in pattern:
                left[x] -= n * times
            return (pattern, times), left

        few = [widest(big, f, counts) for f in _fillings(capacity - big, inside, order, width)]
        seen = {taken[0]}
        for pattern, times in few:
            if pattern not in seen:
                seen.add(pattern)
                yield choice(pattern, times)
        for pattern, times in [taken, *[c for c in few if c[0] != taken[0]]]:
            while times := times // 2:
                yield choice(pattern, times)
        for f in _undominated(capacity - big, inside, order):
            pattern, times = widest(big, f, counts) if f is not None else (None, 0)
            if pattern is None or pattern in seen:
                yield None
                continue
            while times:
                yield choice(pattern, times)
                times //= 2

    best, _, _ = descend(True, [], histogram, float("inf"))
    spent, turn = len(best), 0
    todo: deque[tuple[list[Pattern], Iterator]] = deque()

    def go(start: list[Pattern], counts: dict[int, int]) -> None:
        nonlocal best, spent
        plan, done, open_ = descend(False, start, counts, (bins_of(best) - 1) * capacity - total)
        spent += len(plan) - len(start)
        if done and bins_of(plan) < bins_of(best):
            best = plan
        todo.extend((plan[:k], others(plan[:k], plan[k])) for k in open_)

    if bins_of(best) > bound and spent < nodes:
        go([], histogram)
    while todo and bins_of(best) > bound and spent < nodes:
        turn += 1
        start, left = todo.pop() if turn % 2 else todo.popleft()
        spent += 1
        # what begins with too much waste can't become a better plan
        if waste_of(start) > (bins_of(best) - 1) * capacity - total:
            continue
        try:
            nxt = next(left)
        except StopIteration:
            continue
        if turn % 2:
            todo.append((start, left))
        else:
            todo.appendleft((start, left))
        if nxt is not None:
            go([*start, nxt[0]], nxt[1])
    return best


def slots_of(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset) of each place of a plan."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for items, times in plan:
        at = 0
        for x, n in items:
            lo = rank.get(x, 0)
            rank[x] = lo + n * times
            out.append((x, lo, rank[x], sequence, n, at))
            at += x * n
        sequence += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer: str | None = None, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (and their ``ids``)."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, id_col, text, capacity, end_id, tokenizer, with_ids), "pack-pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = materialize(per_task.select("part", "length", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")),
                           "pack-ranks")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        slots_of(plan_bins(histogram, capacity, nodes)),
        T.StructType([T.StructField(c, T.LongType()) for c in ("l", "lo", "hi", "sequence", "per", "at")]))
    ranked = pieces.join(per_task.drop("n"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    # the plan's size depends on the capacity alone, not on the corpus
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo"))
                         & (F.col("rank") < F.col("hi")))
    i = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (i % F.col("per")) * F.col("length")).cast("long").alias("offset"), *(["ids"] if with_ids else []))
