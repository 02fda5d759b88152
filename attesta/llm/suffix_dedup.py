"""Repeated-window removal by a depth-limited radix sort of suffixes.

Every byte position starts a suffix; only its first ``depth`` bytes count. Most-significant-digit passes split the suffixes
into groups of equal prefixes; a group of one is dropped at once and a group that reaches ``depth`` is exactly a repeated
window. Digits are 64-bit hashes of byte blocks, so a pass is a hash exchange and no suffix is ever carried whole:

1. The first digit of a window is its minimizer, the least-hashed ANCHOR-byte string in it: equal windows have equal
   ones at one offset. Windows that follow each other and share a minimizer travel as one row (about one for 85
   bytes), with the hash of the bytes that they cover together, their hull.
2. A minimizer seen once drops its windows. Equal hulls make all their windows repeated at once. Only where a
   minimizer has several hulls, one row for each of them goes on to the next digits.
3. For these the hulls' bytes are fetched, and windows are split by offset and their first 128 bytes and then by their last 128:
   the digit that reaches the depth. Hulls of a minimizer with more than ``hot`` of them are split by window instead,
   so no group grows in one task.
4. Repeated windows return to their documents, whose covered bytes are removed.

Mappers merge equal rows of their own before each exchange. Defined cases: null texts are empty and keep all of their
nothing; repeated rows repeat each other's windows; rows are told apart by id and a 32-bit hash of id and text;
a null id is a value of its own; texts shorter than the depth keep all bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import exchange as X
from attesta.llm.shared import Scratch, parts_of
from attesta.llm.textarrays import U64, keys64, lean, mix64, slices, text_bytes

DEPTH, ANCHOR, HOT = 200, 32, 4096
SLICE = 1 << 20
FLUSH = 600_000
_BYTES = keys64(256, 71)
_STEP = keys64(16, 72)


def doubled(h: np.ndarray, size: int, level: int) -> np.ndarray:
    """Hashes of 2 * size bytes at each position, from those of size bytes."""
    if len(h) <= size:
        return np.zeros(0, U64)
    out = h[:-size] * _STEP[level]
    out += h[size:]
    out ^= out >> U64(29)
    out *= _STEP[level + 1]
    out ^= out >> U64(32)
    return out


def levels(raw: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of ANCHOR, ..., top bytes (powers of two) at each position."""
    h, size, level, out = _BYTES[raw], 1, 0, {}
    while size < top:
        h = doubled(h, size, level)
        size, level = size * 2, level + 1
        if size >= ANCHOR:
            out[size] = h
    return out


def span_hash(lv: dict[int, np.ndarray], start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of length (ANCHOR at least) bytes at start: two overlapping powers of two."""
    out = np.zeros(len(start), U64)
    size = (1 << np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)).astype(np.int64)
    size = np.minimum(size, max(lv))
    for s in np.unique(size):
        m = size == s
        out[m] = mix64(lv[int(s)][start[m]] * _STEP[14] + lv[int(s)][start[m] + length[m] - s] + length[m].astype(U64) * _STEP[15])
    return out


def top_of(depth: int) -> int:
    """The largest power of two up to the longest hull; two of them cover any hull."""
    return 1 << int(np.floor(np.log2(2 * depth - ANCHOR)))


def runs(raw: np.ndarray, offs: np.ndarray, depth: int, lv: dict[int, np.ndarray]):
    """Document, minimizer position, first and last window start of each run of windows that share a minimizer."""
    n = len(raw) - depth + 1
    none = [np.zeros(0, np.int64)] * 4
    if n <= 0:
        return none
    bits = int(len(raw)).bit_length()
    # the leftmost of equal hashes: an order that depends on the window's bytes alone
    low = (lv[ANCHOR] >> U64(bits) << U64(bits)) | np.arange(len(lv[ANCHOR]), dtype=U64)
    width, size = depth - ANCHOR + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n]) if width > size else low[:n]
    at = (low & U64((1 << bits) - 1)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    lens = np.diff(offs)
    full = lens >= depth
    np.add.at(valid, offs[:-1][full], 1)
    np.add.at(valid, offs[1:][full] - depth + 1, -1)
    ok = np.cumsum(valid[:n]) > 0
    new = np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]
    # texts of exactly ``depth`` bytes may follow each other
    new[offs[:-1][full]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n] - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    doc = np.searchsorted(offs, first, "right") - 1
    return [doc, at[first], first, last]


_ROWS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])
_DDL = "kind int, part int, body binary"
#: Kinds of rows: anchors; repeated windows of a document; requests for the next digits.
FOUND, REPEATED, ASK = 0, 1, 2
_FOUND = (U64, U64, np.int64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8)
_REPEATED = (np.int64, np.uint32, np.uint32, np.uint32)
_ASK = (np.int64, np.uint32, U64, np.uint32, np.uint16, np.uint16, np.uint8)


def _kinded(kind: int, part: np.ndarray, columns):
    for b in X.blobs(part, columns):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), b.column(0), b.column(1)], schema=_ROWS)


def _doc_part(doc: np.ndarray, check: np.ndarray, parts: int) -> np.ndarray:
    return X.part_of(mix64(doc.view(U64) + check.astype(U64) * _STEP[0]), parts)


def _repeated(parts: int, doc, check, start, end):
    """Kind REPEATED; its parts follow those of the anchors."""
    yield from _kinded(REPEATED, _doc_part(doc, check, parts) + np.int32(parts), [doc, check, start, end])


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    doc = b.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
    return doc, b.column("check").to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32)


def _first_digit(depth: int, parts: int):
    def run(batches):
        held, n = [], 0

        def flush():
            anchor, hull, doc, check, p, a, w = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((hull, anchor))
            anchor, hull, doc, check, p, a, w = (c[order] for c in (anchor, hull, doc, check, p, a, w))
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (hull[1:] != hull[:-1])])
            count = np.diff(np.r_[new, len(anchor)])
            many = np.repeat(count > 1, count)
            # known here already; one of them still stands for its hull elsewhere
            yield from _repeated(parts, doc[many], check[many], p[many] - a[many], p[many] - a[many] + w[many])
            yield from _kinded(FOUND, X.part_of(anchor[new], parts), [anchor[new], hull[new], doc[new], check[new], p[new], a[new], w[new], (count > 1).astype(np.uint8)])

        for b in slices(batches, "text", SLICE):
            raw, offs = text_bytes(b.column("text"))
            if len(raw) < depth:
                continue
            lv = levels(raw, min(top_of(depth), 1 << (len(raw).bit_length() - 1)))
            row, at, first, last = runs(raw, offs, depth, lv)
            doc, check = _ids(b)
            hull = span_hash(lv, first, last - first + depth) + mix64((at - first).astype(U64))
            base = offs[row]
            held.append((mix64(lv[ANCHOR][at]), hull, doc[row], check[row], (at - base).astype(np.uint32), (at - first).astype(np.uint16), (last - first).astype(np.uint16)))
            n += len(row)
            if n > FLUSH:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return run


def _split(parts: int, hot: int):
    """Drops minimizers of one hull, tells what equal hulls repeat, asks for the bytes of the others."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == REPEATED:
            return table
        got = [X.unpack(memoryview(b.as_buffer()), _FOUND) for b in table.column("body").combine_chunks()]
        anchor, hull, doc, check, p, a, w, many = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((doc, hull, anchor))
        anchor, hull, doc, check, p, a, w, many = (c[order] for c in (anchor, hull, doc, check, p, a, w, many))
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (hull[1:] != hull[:-1])])
        count = np.diff(np.r_[new, len(anchor)])
        whole = (count > 1) | (many[new] > 0)
        tell = np.repeat(count > 1, count) & (many == 0)
        out = list(_repeated(parts, doc[tell], check[tell], p[tell] - a[tell], p[tell] - a[tell] + w[tell]))
        group = np.flatnonzero(np.r_[True, anchor[new][1:] != anchor[new][:-1]])
        hulls = np.repeat(np.diff(np.r_[group, len(new)]), np.diff(np.r_[group, len(new)]))
        # a minimizer whose hulls are all whole has nothing to ask
        open_ = np.repeat(np.add.reduceat((~whole).astype(np.int64), group) > 0, np.diff(np.r_[group, len(new)])) if len(new) else np.zeros(0, bool)
        ask = (hulls > 1) & open_
        i = new[ask]
        flags = (~whole[ask]).astype(np.uint8) + 2 * (hulls[ask] > hot).astype(np.uint8)
        out += _kinded(ASK, _doc_part(doc[i], check[i], parts), [doc[i], check[i], anchor[i], p[i], a[i], w[i], flags])
        return pa.Table.from_batches(out, schema=_ROWS)

    return run


def _per_document(dtypes):
    """A row for each document: its columns, packed."""

    def fn(part, cols):
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        new = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]).tolist()
        ends = [*new[1:], len(cols[0])]
        return pa.table({"doc": pa.array(cols[0][new]), "check": pa.array(cols[1][new].astype(np.int64)), "rows": pa.array([X.pack([c[s:e] for c in cols[2:]]) for s, e in zip(new, ends)], pa.binary())})

    return fn


#: The next digits' rows: a body holds the packed columns and then, for hulls, their bytes.
_HULL = (U64, np.int64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8)
_WINDOW = (U64, np.int64, np.uint32, np.uint32, np.uint8)


def _fetch(depth: int, parts: int):
    """Hulls with their bytes by minimizer; of hot minimizers the hash of each window, equal ones merged."""

    def run(batches):
        for b in slices(batches, "text", SLICE):
            raw, offs = text_bytes(b.column("text"))
            doc, check = _ids(b)
            cols = [[] for _ in range(8)]
            for k, body in enumerate(b.column("rows")):
                got = X.unpack(memoryview(body.as_buffer()), _ASK[2:])
                for c, v in zip(cols, (got[0], np.full(len(got[0]), doc[k]), np.full(len(got[0]), check[k], np.uint32), *got[1:], np.full(len(got[0]), offs[k]))):
                    c.append(v)
            anchor, d, c, p, a, w, flags, base = (np.concatenate(x) for x in cols)
            start = base + p.astype(np.int64) - a
            size = w.astype(np.int64) + depth
            cold = flags < 2
            part = X.part_of(anchor, parts)
            for q in np.unique(part[cold]):
                i = np.flatnonzero(cold & (part == q))
                at = np.repeat(start[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(int(size[i].sum()))
                body = X.pack([anchor[i], d[i], c[i], p[i], a[i], w[i], flags[i]]) + raw[at].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([int(q)], pa.int32()), pa.array([body], pa.binary())], schema=_ROWS)
            if not cold.all():
                i = np.flatnonzero(~cold)
                n = w[i].astype(np.int64) + 1
                off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                lv = levels(raw, min(top_of(depth), 1 << (len(raw).bit_length() - 1)))
                who = np.repeat(i, n)
                key = span_hash(lv, start[who] + off, np.full(len(who), depth))
                yield from _merged(parts, key, d[who], c[who], (start[who] - base[who] + off).astype(np.uint32), flags[who] & 1)

    return run


def _merged(parts, key, doc, check, at, want):
    """Window rows, equal ones of this slice merged: more than one is known to be repeated."""
    order = np.argsort(key, kind="stable")
    key, doc, check, at, want = (c[order] for c in (key, doc, check, at, want))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[new, len(key)])
    tell = np.repeat(count > 1, count) & (want > 0)
    yield from _repeated(parts, doc[tell], check[tell], at[tell], at[tell])
    flags = want[new] + 2 * (count > 1).astype(np.uint8)
    yield from _kinded(3, X.part_of(key[new], parts) + np.int32(2 * parts), [key[new], doc[new], check[new], at[new], flags.astype(np.uint8)])


def _last_digits(depth: int, parts: int):
    @lean
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == REPEATED:
            return table
        bodies = [memoryview(b.as_buffer()) for b in table.column("body").combine_chunks()]
        if kind == 3:
            key, doc, check, at, flags = (np.concatenate(c) for c in zip(*[X.unpack(b, _WINDOW) for b in bodies]))
            order = np.argsort(key, kind="stable")
            key, doc, check, at, flags = (c[order] for c in (key, doc, check, at, flags))
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[new, len(key)])
            tell = np.repeat(count > 1, count) & (flags == 1)
            return pa.Table.from_batches(_repeated(parts, doc[tell], check[tell], at[tell], at[tell]), schema=_ROWS)
        heads, texts = [], []
        for b in bodies:
            cols = X.unpack(b, _HULL)
            heads.append(cols)
            texts.append(np.frombuffer(b, np.uint8)[8 + len(cols[0]) * sum(np.dtype(t).itemsize for t in _HULL) :])
        anchor, doc, check, p, a, w, flags = (np.concatenate(c) for c in zip(*heads))
        raw = np.concatenate(texts)
        size = w.astype(np.int64) + depth
        base = np.cumsum(size) - size
        out = []
        # whole minimizers, about a megabyte of hulls at a time
        order = np.argsort(anchor, kind="stable")
        bounds = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        weight = np.cumsum(size[order])
        s = 0
        while s < len(bounds):
            e = max(s + 1, int(np.searchsorted(weight[np.r_[bounds[1:], len(order)] - 1], (weight[bounds[s] - 1] if bounds[s] else 0) + (1 << 20), "right")))
            i = order[bounds[s] : bounds[e] if e < len(bounds) else len(order)]
            s = e
            text = raw[np.repeat(base[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(int(size[i].sum()))]
            begin = np.cumsum(size[i]) - size[i]
            n = w[i].astype(np.int64) + 1
            who = np.repeat(np.arange(len(i)), n)
            off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            h = levels(text, 1 << int(np.floor(np.log2(depth))))
            half = max(h)
            # one digit: the offset from the minimizer and the window's first bytes; groups of one go
            digit = mix64(anchor[i][who] + (a[i][who].astype(np.int64) - off).astype(U64) * _STEP[3]) + h[half][begin[who] + off]
            live = repeated_only(digit)
            who, off, digit = who[live], off[live], digit[live]
            # the next: its last bytes, which reach the depth
            live = repeated_only(mix64(digit) + h[half][begin[who] + off + depth - half])
            who, off = who[live], off[live]
            want = (flags[i][who] & 1) > 0
            who, off = who[want], off[want]
            at = (p[i][who].astype(np.int64) - a[i][who] + off).astype(np.uint32)
            if len(who):  # neighbouring windows in one row
                new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1)])
                end = np.r_[new[1:], len(who)] - 1
                out += _repeated(parts, doc[i][who[new]], check[i][who[new]], at[new], at[end])
        return pa.Table.from_batches(out, schema=_ROWS)

    return run


def repeated_only(digit: np.ndarray) -> np.ndarray:
    """Indices, in order, of the values that occur more than once."""
    order = np.argsort(digit, kind="stable")
    d = digit[order]
    same = d[1:] == d[:-1]
    return np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(d) else order


def _remove(depth: int):
    def run(batches):
        for b in slices(batches, "text", SLICE):
            raw, offs = text_bytes(b.column("text"))
            out = {"n_bytes": np.diff(offs), "n_removed": np.zeros(b.num_rows, np.int64), "n_spans": np.zeros(b.num_rows, np.int64)}
            kept, digest = [], []
            for k, body in enumerate(b.column("rows")):
                text = raw[offs[k] : offs[k + 1]]
                if body.is_valid and len(text):
                    start, end = X.unpack(memoryview(body.as_buffer()), _REPEATED[2:])
                    mark = np.zeros(len(text) + 1, np.int32)
                    np.add.at(mark, start.astype(np.int64), 1)
                    np.add.at(mark, end.astype(np.int64) + depth, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    out["n_removed"][k] = gone.sum()
                    out["n_spans"][k] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                kept.append(text.tobytes())
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, out.values()), pa.array(kept, pa.binary()), pa.array(digest)], names=["id", *out, "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (the bytes that stay, not always whole characters), kept_sha256."""
    if depth < 2 * ANCHOR:
        raise ValueError(f"the depth is {2 * ANCHOR} or more")
    spark = docs.sparkSession
    parts = parts_of(spark, docs)
    scratch = Scratch(spark, "suffixes")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63) + 1))).withColumn("check", F.xxhash64("id", "text").bitwiseAND(F.lit(2**32 - 1)))
    first = base.select("doc", "check", "text").mapInArrow(_first_digit(depth, parts), _DDL).groupBy("part").applyInArrow(_split(parts, hot), _DDL)
    first = scratch.table(first, "first")
    asked = X.reduce(first.where(F.col("kind") == ASK).select("part", "body"), parts, _ASK, _per_document(_ASK), "doc long, check long, rows binary")
    fetched = base.select("doc", "check", "text").join(asked.hint("merge"), ["doc", "check"]).mapInArrow(_fetch(depth, parts), _DDL)
    last = scratch.table(fetched.groupBy("part").applyInArrow(_last_digits(depth, parts), _DDL), "last")
    told = first.union(last).where(F.col("kind") == REPEATED).select((F.col("part") - parts).cast("int").alias("part"), "body")
    told = X.reduce(told, parts, _REPEATED, _per_document(_REPEATED), "doc long, check long, rows binary")
    kind = dict(base.dtypes)["id"]
    out = base.join(told.hint("merge"), ["doc", "check"], "left").mapInArrow(_remove(depth), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
