"""Benchmark decontamination: item-sized windows by lossless q-gram counts, then exact edit distance.

A document is contaminated by an item if a passage of it is within k = floor(max_edits * length) edits of the item; texts
are compared by code point with A-Z lower-cased and white space runs as one space. No step loses a passage:

1. Where to look. A passage within k edits keeps L - q + 1 - k q of the item's q-grams, one at least by the choice of q. Items
   of like length share a bucket; positions where an item-sized window holds fewer q-grams of its bucket than that are left out.
2. For which item. The q-grams of what remains are looked up in the bucket's postings, and each item is counted by itself:
   places where a window of its own length holds enough of its own q-grams are candidates.
3. Candidates are verified by bit-parallel approximate matching: the least edit distance of the item to any passage.

Items are sent to workers in blocks of at most ITEMS items and ITEM_CHARS characters, one pass over the documents for each block, so what is
sent has a fixed bound. Nothing is shuffled but the matches. Defined cases: null or empty texts match nothing; items of
fewer than min_chars characters after normalising are not looked for (by default none but empty ones: under 10 characters
k is 0, and any verbatim passage counts); repeated rows give one row of their id; items
with equal text each match; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import Scratch
from attesta.llm.textarrays import U64, keys64, slices

MAX_EDITS, MIN_CHARS = 0.1, 1
Q, TABLE_BITS = 8, 23
ITEMS, ITEM_CHARS = 4096, 4_000_000
SLICE, PENDING, PAIRS = 2 << 20, 100_000, 4_000_000
_SPACES = np.zeros(128, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, a 0 after each, and the n + 1 offsets."""
    cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    offs = np.r_[0, np.cumsum(lens)]
    low = np.minimum(cp, 127)
    cp = np.where((low >= 65) & (low <= 90), cp + np.uint32(32), cp)
    space = _SPACES[low] & (cp < 127)
    cp[space] = 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return cp[keep], np.r_[0, np.cumsum(keep)][offs]


def q_grams(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q code points: of the largest power of two, doubled, and two of these that overlap."""
    keys = keys64(8, 80)
    h, size, k = cp.astype(U64) + U64(1), 1, 0
    while True:
        step = min(size, q - size)
        if len(cp) < q or not step:
            break
        h = h[:-step] * keys[k] + h[step:]
        h ^= h >> U64(31)
        size, k = size + step, k + 1
    h = h[: max(0, len(cp) - q + 1)] * keys[7]
    h ^= h >> U64(29)
    return (h * keys[6] >> U64(64 - TABLE_BITS)).astype(np.int64)


class Bucket:
    """Items of like length and what is needed to look for them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edits: float):
        sizes = [len(x) for _, x in items]
        self.items = items
        self.edits = [int(max_edits * n) for n in sizes]
        # short items have shorter q-grams: one of k + 1 pieces is always intact
        self.q = min(Q, min(n // (k + 1) for n, k in zip(sizes, self.edits)))
        self.need = max(1, min(n - self.q + 1 - k * self.q for n, k in zip(sizes, self.edits)))
        self.width = max(n + k for n, k in zip(sizes, self.edits))
        self.masks = [match_masks(x) for _, x in items]
        self.least = np.array([n - self.q + 1 - k * self.q for n, k in zip(sizes, self.edits)])
        self.wide = np.array([n + k for n, k in zip(sizes, self.edits)])
        grams = [np.unique(q_grams(x, self.q)) for _, x in items]
        # (q-gram, item) in order, so that a range of items is a range of each q-gram's postings
        self.postings = np.sort(np.concatenate(grams) * len(items) + np.repeat(np.arange(len(items)), [len(g) for g in grams]))

    def candidates(self, grams: np.ndarray, at: np.ndarray, lo: int, hi: int):
        """(item, first start, last start) where a window holds enough of the q-grams of an item in [lo, hi). ``at``: places of ``grams``, ascending."""
        n = len(self.items)
        a, b = np.searchsorted(self.postings, grams * n + lo), np.searchsorted(self.postings, grams * n + hi)
        count = b - a
        total = int(count.sum())
        if total > PAIRS and hi - lo > 1:
            yield from self.candidates(grams, at, lo, (lo + hi) // 2)
            yield from self.candidates(grams, at, (lo + hi) // 2, hi)
            return
        item = self.postings[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(total)] % n
        order = np.argsort(item.astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")
        item, at = item[order], np.repeat(at, count)[order]
        last = np.arange(total) + self.least[item] - 1
        first = np.flatnonzero(last < total)
        first = first[item[last[first]] == item[first]]
        reach = self.wide[item[first]] - self.q
        near = at[last[first]] - at[first] <= reach
        first, reach = first[near], reach[near]
        item, a, e = item[first], at[last[first]] - reach, at[first]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (a[1:] > e[:-1] + 1)][: len(item)])
        yield from zip(item[new].tolist(), a[new].tolist(), e[np.r_[new[1:], len(item)][: len(new)] - 1].tolist())


def match_masks(pattern: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of the pattern to a passage of the text, and where the first such passage ends (Myers, 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def make_buckets(items: list[tuple[int, np.ndarray]], max_edits: float) -> list[Bucket]:
    """At most 32 buckets of items in order of length."""
    items = sorted(items, key=lambda x: (len(x[1]), x[0]))
    if not items:
        return []
    lo, hi = len(items[0][1]), len(items[-1][1])
    ratio = max(1.1, (hi / lo) ** (1 / 31) * 1.0001)
    groups: dict[int, list] = {}
    for x in items:
        groups.setdefault(int(np.log(len(x[1]) / lo) / np.log(ratio)), []).append(x)
    return [Bucket(g, max_edits) for _, g in sorted(groups.items())]


def _find(items: list[tuple[int, np.ndarray]], max_edits: float):
    def run(batches):
        buckets = make_buckets(items, max_edits)
        tables: dict[int, np.ndarray] = {}
        for n, b in enumerate(buckets):
            t = tables.setdefault(b.q, np.zeros(1 << TABLE_BITS, np.uint32))
            for _, x in b.items:
                t[q_grams(x, b.q)] |= np.uint32(1 << n)
        pending: list[list] = [[] for _ in buckets]
        held = [0] * len(buckets)
        rows: list[tuple] = []

        def settle(n):
            """Candidates of the held regions of a bucket, verified."""
            b, regions = buckets[n], pending[n]
            sizes = np.array([len(r[1]) for r in regions])
            # regions lie so far apart that no window holds q-grams of two
            base = np.cumsum(sizes + b.width) - sizes - b.width
            cp = np.zeros(base[-1] + sizes[-1] + b.width, np.uint32)
            for r, start in zip(regions, base.tolist()):
                cp[start : start + len(r[1])] = r[1]
            grams = q_grams(cp, b.q)
            at = np.flatnonzero(tables[b.q][grams] & np.uint32(1 << n))
            for i, first, last in b.candidates(grams[at], at, 0, len(b.items)):
                k = int(np.searchsorted(base, last, "right")) - 1
                r, first, last = regions[k], max(0, first - int(base[k])), last - int(base[k])
                d, end = best_match(b.masks[i], len(b.items[i][1]), r[1][first : last + int(b.wide[i])].tolist())
                if d <= b.edits[i]:
                    rows.append((r[0], b.items[i][0], d, len(b.items[i][1]), r[3] + first + end))
            pending[n], held[n] = [], 0

        def answer():
            cols = list(zip(*rows)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "item_chars", "end"])

        for batch in slices(batches, "text", SLICE):
            ids = batch.column("doc_id").to_pylist()
            cp, offs = code_points(pc.fill_null(batch.column("text"), "").to_pylist())
            for q, table in tables.items():
                hits = table[q_grams(cp, q)]
                where = np.flatnonzero(hits)
                hits = hits[where]
                for n, b in enumerate(buckets):
                    if b.q != q:
                        continue
                    for a, e in regions_of(where[hits & np.uint32(1 << n) != 0], b):
                        # a region is cut where documents meet
                        d = int(np.searchsorted(offs, a, "right")) - 1
                        while a < e:
                            stop = int(offs[d + 1]) - 1
                            if a < min(e, stop):
                                to = min(e, stop)
                                pending[n].append((ids[d], cp[a : min(to + b.width, stop)], to - a, a - int(offs[d])))
                                held[n] += len(pending[n][-1][1])
                            a, d = stop + 1, d + 1
                    if held[n] > PENDING:
                        settle(n)
            if len(rows) > 10_000:
                yield answer()
        for n in range(len(buckets)):
            if pending[n]:
                settle(n)
        yield answer()

    return run


def regions_of(at: np.ndarray, b: Bucket) -> list[tuple[int, int]]:
    """Runs [a, e) of starts whose window holds enough of the bucket's q-grams, which begin at ``at``."""
    reach = b.width - b.q
    if len(at) < b.need:
        return []
    first, last = at[: len(at) - b.need + 1], at[b.need - 1 :]
    near = np.flatnonzero(last - first <= reach)
    if not len(near):
        return []
    a, e = np.maximum(last[near] - reach, 0), first[near] + 1
    cut = np.flatnonzero(a[1:] > e[:-1])
    return list(zip(a[np.r_[0, cut + 1]].tolist(), e[np.r_[cut, len(a) - 1]].tolist()))


def find_items(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, item_chars, end: the closest passage of each document for each item that it holds."""
    Scratch(docs.sparkSession, "benchmark")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None

    def look(block):
        nonlocal found
        part = base.where("text is not null").mapInArrow(_find(block, max_edits), "doc_id long, item_id long, distance long, item_chars long, end long")
        found = part if found is None else found.union(part)

    block: list[tuple[int, np.ndarray]] = []
    # item by item, so that the driver never holds more than a block
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null").toLocalIterator():
        cp, _ = code_points([r["t"].strip(" \t\n\v\f\r")])
        if len(cp) - 1 >= max(1, min_chars):
            block.append((r["i"], cp[:-1]))
        if len(block) >= ITEMS or sum(len(x) for _, x in block[-64:]) > ITEM_CHARS // 64 and sum(len(x) for _, x in block) > ITEM_CHARS:
            look(block)
            block = []
    if block or found is None:
        look(block)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "item_chars", "end")).alias("m")).select("doc_id", "item_id", "m.*")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
