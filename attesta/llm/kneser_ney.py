"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Vocabulary. Words are 64-bit hashes; one exchange counts them all, and a word's id is its place among all words by falling
count (by power of two, then by hash). Frequent words so have small ids, n-grams travel as ids of few bytes, and the words
that are hot, a two-thousandth of all tokens or more, are those below one id.

Counting. A mapper counts the n-grams of about CHUNK_TOKENS tokens in numpy and sends packed counts by the hash of their
context, so one reducer sees all of a context. Contexts of hot words alone are split by the last word too. A
reducer writes its n-grams and whole contexts as shards, sends the sums of split contexts on and, for the next lower order, one for each
distinct n-gram to its suffix; so lower orders hold continuation counts. Each order is one exchange, whose rows are a table.

Storage. A shard holds its sorted hashes after a directory of their leading bits, 32 bits of each (words: all 64), and a byte for
each count. Workers map the shards from the shared folder, or read them into bounded memory where the store can't be mapped.

Scoring. Whole slices of text are looked up at once:
p(w|h) = max(c - D(c), 0) / c(h) + gamma(h) p(w|h'), down to 1 / (V + 1). A text begins after start marks and ends with one end
token. Nothing of the model is sent to the driver but one row of sums for each shard of the vocabulary, and one for each order.

n-grams are told apart by their directory bits and 32 more, 50 or more in a shard of a million. Defined cases: a null text is empty and
has the end token alone; a null id is not held out; repeated rows all count; with no training rows every token has
probability 1 / (V + 1) = 1; an unseen context backs off whole; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import exchange as X
from attesta.llm.charfeatures import held_out
from attesta.llm.shared import Scratch, filesystem, parts_of, put
from attesta.llm.textarrays import U64, keys64, mix64, order_of, release, slices, text_bytes, word_hashes, words

END = U64(keys64(2, 61)[1])
#: Ids before those of the words.
START, UNKNOWN, FIRST = 0, 1, 2
ORDER = 3
COUNT_SLICE, SCORE_SLICE = 1 << 20, 4 << 20
CHUNK_TOKENS = 3_000_000
HOT_SHARE, HOT_SPLITS = 2000, 64
#: Bytes of shards that a worker holds at once where they can't be mapped.
HELD_BYTES = 256 << 20
CLASSES = 64
_ROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary()), ("stats", pa.list_(pa.int64()))])
_DDL = "kind int, part int, body binary, stats array<long>"
STATS, GRAMS, SPLIT = -1, 0, 1


def token_rows(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end token of each row, and their rows."""
    raw, offs = text_bytes(texts)
    starts, ends, rows = words(raw, offs)
    n = len(offs) - 1
    after = np.searchsorted(rows, np.arange(n), "right")
    return np.insert(word_hashes(raw, starts, ends), after, END), np.insert(rows, after, np.arange(n))


def with_starts(ids: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns w_1 .. w_order of the n-gram that ends in each token."""
    cols, start = [ids], ids.dtype.type(START)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    for k in range(1, order):
        back = np.r_[np.full(min(k, len(ids)), start), ids[: max(0, len(ids) - k)]]
        cols.insert(0, np.where(place >= k, back, start))
    return cols


_KEYS = keys64(64, 62)


def gram_key(cols: list[np.ndarray]) -> np.ndarray:
    out = (cols[0] + U64(1)) * _KEYS[0]
    for c, k in zip(cols[1:], _KEYS[1:]):
        out ^= out >> U64(29)
        out += c
        out *= k
    return mix64(out)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts of the runs of equal keys in that order, and the distinct keys."""
    order = order_of(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return order, first, key[first]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def combine(cols: list[np.ndarray], c: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted keys, columns and summed counts (without c: numbers) of the distinct n-grams."""
    order, first, key = runs_of(gram_key(cols))
    n = np.diff(np.r_[first, len(order)]) if c is None else sums(c[order], first)
    at = order[first]
    return key, [x[at] for x in cols], n


def shard_of(cols: list[np.ndarray], hot: int, parts: int) -> np.ndarray:
    """The shard by context; contexts of hot words alone are split by the last word."""
    if len(cols) == 1:
        return X.part_of(gram_key(cols), parts)
    split = np.logical_and.reduce([c < hot for c in cols[:-1]])
    return X.part_of(mix64(gram_key(cols[:-1]) + np.where(split, cols[-1] % U64(HOT_SPLITS), U64(0)) * U64(0x9E3779B97F4A7C15)), parts)


def encode(cols: list[np.ndarray], c: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bytes as byte planes, the first column (ascending) by difference; a byte for each count, larger ones after them."""
    first = np.r_[cols[0][:1], np.diff(cols[0])]
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for x in (first, *cols[1:])]
    raw = b"".join([*planes, np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype(np.int64).tobytes()])
    return np.array([len(c), len(raw)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def decode(body, n_cols: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, size = np.frombuffer(body, np.int64, 2).tolist()
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(memoryview(body)[16:], size, asbytes=True), np.uint8)
    cols = []
    for k in range(n_cols):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[k * n * width : (k + 1) * n * width].reshape(width, n).T
        cols.append(wide.view("<u8").ravel())
    cols[0] = np.cumsum(cols[0], dtype=U64) & U64((1 << 8 * width) - 1)
    at = n_cols * n * width
    c = raw[at : at + n].astype(np.int64)
    c[c == 255] = np.frombuffer(raw[at + n :].tobytes(), np.int64)
    return cols, c


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows) if rows else [[]] * 4, _ROW)], schema=_ROW)


def gram_rows(parts: int, hot: int, width: int, cols: list[np.ndarray], c: np.ndarray):
    """A row for each part, its n-grams by their first word, whose differences then are small."""
    part = shard_of(cols, hot, parts)
    bits = max(1, len(c).bit_length())
    spare = 64 - bits - int(parts).bit_length()
    lead = np.minimum(cols[0], U64((1 << min(spare, 63)) - 1))
    key = (part.astype(U64) << U64(64 - int(parts).bit_length())) | (lead << U64(bits)) | np.arange(len(c), dtype=U64)
    key.sort()
    order = (key & U64((1 << bits) - 1)).astype(np.int64)
    part, cols, c = part[order], [x[order] for x in cols], c[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(GRAMS, int(part[a]), encode([x[a:b] for x in cols], c[a:b], width), None) for a, b in zip(cuts, cuts[1:]) if b > a]


# shards


def write_shard(path: str, keys: np.ndarray, columns: list[np.ndarray], whole: bool = False, extra: np.ndarray | None = None) -> None:
    """Sizes; directory, hashes (32 bits after the directory's, or all 64), a byte for each value, large values, the extra column."""
    n = len(keys)
    bits = max(0, n.bit_length() - 3)
    lead = (keys >> U64(64 - bits)) if bits else np.zeros(n, U64)
    directory = np.searchsorted(lead, np.arange((1 << bits) + 1, dtype=U64)).astype(np.uint32)
    rest = keys if whole else ((keys << U64(bits)) >> U64(32)).astype(np.uint32)
    large = [np.flatnonzero(c >= 255) for c in columns]
    head = np.array([n, bits, int(whole), int(extra is not None), len(columns), *(len(x) for x in large)], np.int64)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    pieces = [head.tobytes(), directory.tobytes(), rest.tobytes(), *(np.minimum(c, 255).astype(np.uint8).tobytes() for c in columns)]
    for c, at in zip(columns, large):
        pieces += [at.astype(np.int64).tobytes(), c[at].astype(np.int64).tobytes()]
    if extra is not None:
        pieces.append(extra.astype(np.uint32).tobytes())
    put(path, [pad(x) for x in pieces])


class Shard:
    def __init__(self, raw: np.ndarray):
        n, self.bits, whole, extra, n_cols = raw[:40].view(np.int64).tolist()
        large = raw[40 : 40 + 8 * n_cols].view(np.int64).tolist()
        at = 40 + 8 * n_cols

        def take(dtype, size):
            nonlocal at
            got = raw[at : at + size * np.dtype(dtype).itemsize].view(dtype)
            at += -(-size * np.dtype(dtype).itemsize // 8) * 8
            return got

        self.n, self.size = n, len(raw)
        self.directory = take(np.uint32, (1 << self.bits) + 1)
        self.rest, self.whole = take(U64 if whole else np.uint32, n), bool(whole)
        self.columns = [take(np.uint8, n) for _ in range(n_cols)]
        self.large = [(take(np.int64, m), take(np.int64, m)) for m in large]
        self.extra = take(np.uint32, n) if extra else None

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and whether they are there: a search of whole arrays within the directory's buckets."""
        bucket = (q >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(q), np.int64)
        lo, end = self.directory[bucket].astype(np.int64), self.directory[bucket + 1].astype(np.int64)
        want = q if self.whole else ((q << U64(self.bits)) >> U64(32)).astype(np.uint32)
        hi = end.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (self.rest[np.minimum(mid, self.n - 1)] < want) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        place = np.minimum(lo, self.n - 1)
        return place, (lo < end) & (self.rest[place] == want)

    def values(self, k: int, at: np.ndarray) -> np.ndarray:
        c = self.columns[k][at].astype(np.int64)
        big = np.flatnonzero(c == 255)
        if len(big):
            places, values = self.large[k]
            c[big] = values[np.searchsorted(places, at[big])]
        return c


class Shards:
    """Lookup by key in all shards of one name. width: columns, with an extra one if there is one."""

    def __init__(self, prefix: str, width: int):
        self.prefix, self.width = prefix, width
        self.open: OrderedDict[int, Shard | None] = OrderedDict()
        self.held = 0

    def _shard(self, part: int) -> Shard | None:
        if part not in self.open:
            fs, at = filesystem(f"{self.prefix}{part:06d}")
            if fs.get_file_info(at).type == pafs.FileType.NotFound:
                self.open[part] = None
            elif fs.type_name == "local":
                self.open[part] = Shard(np.asarray(np.memmap(at, np.uint8, "r")))
            else:
                with fs.open_input_file(at) as file:
                    self.open[part] = Shard(np.frombuffer(file.read(), np.uint8))
                self.held += self.open[part].size
                while self.held > HELD_BYTES and len(self.open) > 1:
                    gone = self.open.popitem(last=False)[1]
                    self.held -= gone.size if gone else 0
        return self.open[part]

    def get(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The values of each key, a row for each column; 0 for what is not there."""
        out = np.zeros((self.width, len(key)), np.int64)
        order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
        dealt = part[order]
        cuts = np.flatnonzero(np.diff(dealt)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), [*cuts.tolist(), len(dealt)]):
            shard = self._shard(int(dealt[a])) if a < b else None
            if shard is not None and shard.n:
                where = order[a:b]
                at, hit = shard.find(key[where])
                at, where = at[hit], where[hit]
                for k in range(len(shard.columns)):
                    out[k, where] = shard.values(k, at)
                if shard.extra is not None:
                    out[-1, where] = shard.extra[at]
        return out


# the vocabulary


def _words(parts: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first, h = runs_of(h)
            # parts are ranges of the hash, so the sorted words are dealt already
            yield from X.blobs(X.part_of(h, parts), [h, sums(c[order], first)])

        for b in slices(batches, "text", COUNT_SLICE):
            order, first, h = runs_of(token_rows(b.column("text"))[0])
            held.append((h, np.diff(np.r_[first, len(order)])))
            n += len(h)
            if n > CHUNK_TOKENS:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return run


def _class_of(c: np.ndarray) -> np.ndarray:
    """0 for the most frequent words: the power of two of the count, falling."""
    return CLASSES - 1 - np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def _vocabulary(folder: str):
    def fn(part, cols):
        order, first, h = runs_of(cols[0])
        c = sums(cols[1][order], first)
        kind = _class_of(c)
        by_class = np.argsort(kind.astype(np.uint8), kind="stable")
        n = np.bincount(kind, minlength=CLASSES)
        rank = np.empty(len(h), np.int64)
        rank[by_class] = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        write_shard(f"{folder}/words-{part:06d}", h, [c], whole=True, extra=rank)
        return pa.Table.from_batches([_batch([(STATS, part, None, [len(h), int(c.sum()), *n.tolist()])])])

    return fn


class Vocabulary:
    """Ids and counts of words."""

    def __init__(self, folder: str, parts: int, n_words: int, n_tokens: int, hot: int):
        self.folder, self.parts, self.n_words, self.n_tokens, self.hot = folder, parts, n_words, n_tokens, hot
        self.width = max(1, -(-int(n_words + FIRST).bit_length() // 8))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each distinct word."""
        if not hasattr(self, "_shards"):
            fs, at = filesystem(f"{self.folder}/places")
            with fs.open_input_file(at) as file:
                self._places = np.frombuffer(file.read(), np.int64).reshape(-1, CLASSES)
            self._shards = Shards(f"{self.folder}/words-", 2)
        part = X.part_of(h, self.parts)
        c, rank = self._shards.get(part, h)
        return np.where(c > 0, FIRST + self._places[part, _class_of(c)] + rank, UNKNOWN).astype(U64), c

    def tokens(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id and count of each distinct word; which of them each token is, and its row."""
        h, rows = token_rows(texts)
        order, first, one = runs_of(h)
        ids, c = self.look(one)
        again = np.empty(len(h), np.int64)
        again[order] = np.repeat(np.arange(len(one)), np.diff(np.r_[first, len(h)]))
        return ids, c, again, rows


def read_vocabulary(texts: DataFrame, scratch: Scratch, parts: int) -> Vocabulary:
    folder = scratch.at("shards")
    rows = scratch.table(X.reduce(texts.mapInArrow(_words(parts), X.BLOB), parts, (U64, np.int64), _vocabulary(folder), _DDL), "vocabulary")
    n = np.zeros((parts, CLASSES), np.int64)
    n_tokens = 0
    for r in rows.select("part", "stats").toLocalIterator():
        n[r["part"]] = r["stats"][2:]
        n_tokens += r["stats"][1]
    of_class = n.sum(0)
    put(f"{folder}/places", [(np.cumsum(of_class) - of_class + np.cumsum(n, 0) - n).tobytes()])
    hot_classes = [k for k in range(CLASSES) if (1 << (CLASSES - 1 - k)) * HOT_SHARE >= n_tokens]
    return Vocabulary(folder, parts, int(of_class.sum()), n_tokens, FIRST + int(of_class[hot_classes].sum()))


# n-grams


def _count(order: int, parts: int, vocabulary: Vocabulary):
    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            _, cols, c = combine(cols, None)
            yield _batch(gram_rows(parts, vocabulary.hot, vocabulary.width, cols, c))

        for b in slices(batches, "text", COUNT_SLICE):
            ids, _, word, rows = vocabulary.tokens(b.column("text"))
            if held and n + len(word) > CHUNK_TOKENS:
                yield from flush()
                n = 0
            held.append(with_starts(ids[word], rows, order))
            n += len(word)
        if held:
            yield from flush()

    return run


_SPLIT = (U64, *[np.int64] * 4)


def _level(folder: str, level: int, parts: int, hot: int, width: int):
    """One exchange's reducer: n-grams and contexts become shards, sums of split contexts and lower n-grams go on."""

    def run(batches):
        grams, split, part = [], [], 0
        for b in batches:
            for kind, at, body in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("body")):
                part, body = at, memoryview(body.as_buffer())
                if kind == GRAMS:
                    grams.append(decode(body, level, width))
                else:
                    split.append(X.unpack(body, _SPLIT))
        out = []
        if split:
            ctx, *values = (np.concatenate(x) for x in zip(*split))
            order, first, key = runs_of(ctx)
            write_shard(f"{folder}/split-{level + 1}-{part:06d}", key, [sums(x[order], first) for x in values])
        if grams:
            cols, c = [np.concatenate(x) for x in zip(*(g for g, _ in grams))], np.concatenate([n for _, n in grams])
            grams.clear()
            key, cols, c = combine(cols, c)
            write_shard(f"{folder}/grams-{level}-{part:06d}", key, [c])
            out.append((STATS, part, None, [level, len(c), int(c.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]))
            if level > 1:
                order, first, ctx = runs_of(gram_key(cols[:-1]))
                got = c[order]
                values = [sums(x.astype(np.int64), first) for x in (got, got == 1, got == 2, got > 2)]
                lead = order[first]
                hot_one = np.logical_and.reduce([x[lead] < hot for x in cols[:-1]])
                write_shard(f"{folder}/contexts-{level}-{part:06d}", ctx[~hot_one], [x[~hot_one] for x in values])
                for b in X.blobs(X.part_of(ctx[hot_one], parts), [ctx[hot_one], *(x[hot_one] for x in values)]):
                    out += [(SPLIT, p, body, None) for p, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist())]
                del order, got, ctx
                _, lower, n = combine(cols[1:], None)
                out += gram_rows(parts, hot, width, lower, n)
        if out:
            yield _batch(out)
        release()

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) from the numbers of n-grams seen 1, 2, 3 and 4 times, each within [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.01), k) for k, x in enumerate(d, 1))])


class Model:
    """Everything a worker needs: where the shards are, and a few numbers for each order."""

    def __init__(self, order: int, parts: int, vocabulary: Vocabulary, stats: dict[int, list[int]]):
        self.order, self.parts, self.vocabulary, self.folder = order, parts, vocabulary, vocabulary.folder
        self.stats = {k: stats.get(k, [0] * 6) for k in range(1, order + 1)}
        self.d = {k: discounts(s[2:6]) for k, s in self.stats.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _get(self, name: str, width: int, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        cache = self.__dict__.setdefault("_open", {})
        if name not in cache:
            cache[name] = Shards(f"{self.folder}/{name}-", width)
        return cache[name].get(part, key)

    def counts(self, cols: list[np.ndarray]) -> np.ndarray:
        return self._get(f"grams-{len(cols)}", 1, shard_of(cols, self.vocabulary.hot, self.parts), gram_key(cols))[0]

    def contexts(self, cols: list[np.ndarray]) -> np.ndarray:
        """Of each context: the total of its n-grams' counts, and how many have a count of one, of two and of more."""
        key = gram_key(cols)
        split = np.logical_and.reduce([x < self.vocabulary.hot for x in cols])
        out = np.zeros((4, len(key)), np.int64)
        for name, m, part in (("split", split, lambda k: X.part_of(k, self.parts)), ("contexts", ~split, lambda k: X.part_of(mix64(k), self.parts))):
            if m.any():
                out[:, m] = self._get(f"{name}-{len(cols) + 1}", 4, part(key[m]), key[m])
        return out

    def probabilities(self, ids: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        """Of the n-gram that ends in each token. ids: of the distinct words; places: columns of indices to these. Single words are looked up once."""
        types, total, n1, n2 = self.stats[1][:4]
        p = np.full(len(places[0]), 1 / (self.vocabulary.n_words + 1))
        for level in range(1, self.order + 1):
            cols = [ids[x] for x in places[-level:]] if level > 1 else []
            c = self.counts(cols) if cols else self.counts([ids])[places[-1]]
            if level == 1:
                context = np.array([total, n1, n2, types - n1 - n2])[:, None]
            else:
                context = self.contexts(cols[:-1]) if level > 2 else self.contexts([ids])[:, places[-2]]
            d, whole = self.d[level], np.maximum(context[0], 1)
            gamma = np.where(context[0] > 0, (d[1] * context[1] + d[2] * context[2] + d[3] * context[3]) / whole, 1.0)
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / whole + gamma * p
        return p


def _score(model: Model):
    def run(batches):
        v = model.vocabulary
        for b in slices(batches, "text", SCORE_SLICE):
            ids, c, word, rows = v.tokens(b.column("text"))
            n = b.num_rows
            base = np.log10((c + 0.1) / (v.n_tokens + 0.1 * (v.n_words + 1)))[word]
            # index 0 stands for the start mark
            log_p = np.log10(model.probabilities(np.r_[U64(START), ids], with_starts(word + 1, rows, model.order)))
            out = {
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
                "n_tokens": pa.array(np.bincount(rows, minlength=n)), "n_known": pa.array(np.bincount(rows, weights=(c > 0)[word], minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, v.n_tokens, np.int64)),
                "base_score": pa.array(np.bincount(rows, weights=base, minlength=n)), "score": pa.array(np.bincount(rows, weights=log_p, minlength=n)),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def train(texts: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """A model of the column ``text``. order: words in the longest n-gram, 2 at least."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    parts = parts_of(texts.sparkSession, texts)
    vocabulary = read_vocabulary(texts, scratch, parts)
    rows, stats = texts.mapInArrow(_count(order, parts, vocabulary), _DDL), {}
    for level in range(order, 0, -1):
        rows = X.deal(rows.where(F.col("kind") != STATS), parts).mapInArrow(_level(vocabulary.folder, level, parts, vocabulary.hot, vocabulary.width), _DDL)
        rows = scratch.table(rows, f"level{level}")
        found = rows.where(F.col("kind") == STATS).select(F.posexplode(F.slice("stats", 2, 6))).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        stats[level] = [n for _, n in sorted((r["pos"], r["n"]) for r in found)] or [0] * 6
        if level < order:
            scratch.drop(f"level{level + 1}")
    return Model(order, parts, vocabulary, stats)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, remainder: int = 0, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10); learns from what is not held out."""
    scratch = Scratch(docs.sparkSession, "lm")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", modulus, remainder))
    model = train(base.where("not held_out").select("text"), scratch, order)
    return base.mapInArrow(_score(model), f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
