"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Two documents link when 100 * |A n B| >= percent * |A u B|. Steps, each over all documents:

1. Exact sets collapse: documents with one set (128-bit fingerprint and size) form a class.
2. A class posts the p smallest hashes of its set, p = n - ceil(percent n / 100) + l. Linked sets share l of
   them, not just one, so a shared passage alone does not make a candidate.
3. Each posted shingle's document frequency goes back to its classes. A class with too few shared shingles is
   out; another keeps its rarest ones, as many as the prefix principle needs for one common shingle.
4. Classes with identical kept prefixes and size collapse into one group. Pairs of groups that hold a common shingle are filtered by
   size and by place: as many shared shingles as a link asks for must be left in both, from this one on. Of a shingle of more than PAIRED groups
   neighbours in size are paired alone, which connects all that fit, so no list gives a square of pairs.
5. Pairs are expanded to the members of their groups. Where more are connected than one task verifies, mostly by passages that many texts
   share, steps 3 and 4 are done again with all shingles of these sets: three quarters of them must be shared with a set that is connected.
6. Pairs that are still connected travel together, so a text is sent once and not with each partner; they meet in one task, or chunk by
   chunk, and links are verified exactly on whole sets. What is already connected by verified links needs no test.

Defined cases: a text of 1 to 4 words is one shingle of all its words; a text that is null, empty or without
words has size 0 and links with nothing; repeated rows keep one row each; of rows that share an id each has the
component of its own text; a row with a null id is kept, with a null component; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import exchange as X
from attesta.llm.components import components, local_labels
from attesta.llm.shared import Scratch, parts_of
from attesta.llm.textarrays import U64, grams, keys64, lean, mix64, row_runs, slices, text_bytes, word_hashes, words

SLICE = 1 << 20
#: Shingles, and for each set 32 more, that one task verifies at once.
CHUNK = 500_000
#: Groups of a shingle of which every pair is looked at; of more, neighbours in size.
PAIRED = 32


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offs = text_bytes(texts)
    starts, ends, rows = words(raw, offs)
    h = word_hashes(raw, starts, ends)
    g, grow = grams(h, rows, size)
    n = len(offs) - 1
    at, cut = row_runs(grow, n), row_runs(rows, n)
    out = []
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if b - a >= size:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif b > a:
            out.append(mix64(np.array([(h[a:b] * keys64(int(b - a), 22)).sum()], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


_SALT = keys64(2, 31)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix64(s ^ _SALT[0]).sum(dtype=U64)), int(mix64(s ^ _SALT[1]).sum(dtype=U64))


def _least(n, percent: int):
    """Fewest common shingles of a set of n with a linked one."""
    return -(-percent * n // 100)


def _extra(n, percent: int):
    """Common shingles asked of the prefixes: a twentieth of the set."""
    return np.minimum(1 + n // 20, np.maximum(_least(n, percent), 1))


def _prefix(n, percent: int):
    return n - _least(n, percent) + _extra(n, percent)


def _info(size: int):
    def run(batches):
        for b in slices(batches, "text", SLICE):
            sets = shingle_sets(b.column("text"), size)
            prints = np.array([fingerprint(s) for s in sets], U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["doc_id", "row", "n", "lo", "hi"])

    return run


def _postings(size: int, percent: int, parts: int):
    def run(batches):
        done: set[int] = set()
        held, cls, count = [], [], 0

        def flush():
            token = np.concatenate(held)
            yield from X.blobs(X.part_of(mix64(token), parts), [token, np.repeat(np.array(cls, U64), [len(x) for x in held])])
            held.clear()
            cls.clear()

        for b in slices(batches, "text", SLICE):
            for s in shingle_sets(b.column("text"), size):
                if len(s) and (lo := fingerprint(s)[0]) not in done:
                    done.add(lo)
                    held.append(s[: _prefix(len(s), percent)].copy())
                    cls.append(lo)
                    count += len(held[-1])
            if count > 1_000_000:
                yield from flush()
                count = 0
        if held:
            yield from flush()

    return run


def _whole_postings(size: int, parts: int):
    """All shingles of each class, as they are within its connected classes."""

    def run(batches):
        for b in slices(batches, "text", SLICE):
            comp = mix64(b.column("comp").to_numpy().view(U64))
            lo = b.column("lo").to_numpy().view(U64)
            sets = shingle_sets(b.column("text"), size)
            # the rows of an id may have other texts
            some = [i for i, s in enumerate(sets) if len(s) and fingerprint(s)[0] == lo[i]]
            if some:
                token = np.concatenate([mix64(sets[i] ^ comp[i]) for i in some])
                yield from X.blobs(X.part_of(token, parts), [token, np.repeat(lo[some], [len(sets[i]) for i in some])])

    return run


def _class_blobs(parts: int):
    def run(batches):
        for b in batches:
            lo = b.column("lo").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            n = b.column("n").to_numpy(zero_copy_only=False).astype(U64)
            yield from X.blobs(X.part_of(lo, parts), [lo, n, np.zeros(len(lo), np.uint32)])

    return run


def _table(batches) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=X._BLOB)


def _frequencies(parts: int):
    """Posted shingles of two classes or more, sent on to their classes with the number of classes."""

    def run(part, cols):
        token, cls = cols
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.repeat(np.diff(np.r_[first, len(token)]), np.diff(np.r_[first, len(token)]))
        keep = df > 1
        return _table(X.blobs(X.part_of(cls[keep], parts), [cls[keep], token[keep], np.minimum(df[keep], 2**32 - 1).astype(np.uint32)]))

    return run


_KINDS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])


def _groups(least, parts: int):
    """Kind 0: class, group, size. Kind 1: kept shingle, group, size, shared shingles from this one on. least: posted shingles that sets of n have in common with a linked one."""

    def run(part, cols):
        cls, token, df = cols
        info = df == 0
        known, at = np.unique(cls[info], return_index=True)
        n_of = token[info][at].astype(np.int64)
        cls, token, df = cls[~info], token[~info], df[~info]
        order = np.lexsort((token, df, cls))
        cls, token = cls[order], token[order]
        out: list[tuple[int, pa.RecordBatch]] = []
        if len(cls):
            first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            shared = np.diff(np.r_[first, len(cls)])
            own = cls[first]
            n = n_of[np.searchsorted(known, own)]
            need = least(n)
            kept = np.maximum(shared - need + 1, 0)
            rank = np.arange(len(cls)) - np.repeat(first, shared)
            keep = rank < np.repeat(kept, shared)
            token, left, live = token[keep], (np.repeat(shared, shared) - rank)[keep], kept > 0
            own, n, kept = own[live], n[live], kept[live]
            if len(own):
                starts = np.cumsum(kept) - kept
                group = mix64(np.add.reduceat(mix64(token ^ _SALT[1]), starts) + n.astype(U64) * _SALT[0])
                out += [(0, b) for b in X.blobs(X.part_of(group, parts), [own, group, n.astype(np.uint32)])]
                _, one = np.unique(group, return_index=True)
                mine = np.zeros(len(group), bool)
                mine[one] = True
                pick = np.repeat(mine, kept)
                t = token[pick]
                out += [(1, b) for b in X.blobs(X.part_of(mix64(t), parts), [t, np.repeat(group[mine], kept[mine]), np.repeat(n[mine], kept[mine]).astype(np.uint32), left[pick].astype(np.uint32)])]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32)), b.column(0), b.column(1)], schema=_KINDS) for k, b in out], schema=_KINDS)

    return run


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _pairs(percent: int, least):
    """A forest of the pairs of groups that share a kept shingle and pass the filters."""

    def run(part, cols):
        token, group, n, left = cols
        order = np.lexsort((group, n, token))
        token, group, n, left = token[order], group[order], n[order].astype(np.int64), left[order].astype(np.int64)
        own, index = np.unique(group, return_inverse=True)
        need = least(n)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        length = np.diff(np.r_[first, len(token)])
        size = np.repeat(length, length)
        label = np.arange(len(own))
        for d in range(1, int(min(PAIRED, length.max(initial=0)))):
            i = np.flatnonzero((token[:-d] == token[d:]) & ((size[:-d] <= PAIRED) | (d == 1)))
            j = i + d
            fits = 100 * n[i] >= percent * n[j]
            # neighbours of a long list stand for pairs that are not looked at
            placed = (np.minimum(left[i], left[j]) >= np.maximum(need[i], need[j])) | (size[i] > PAIRED)
            i, j = i[fits & placed], j[fits & placed]
            u, v = label[index[i]], label[index[j]]
            if (u != v).any():
                label = local_labels(len(own), u, v)[label]
        moved = np.flatnonzero(label != np.arange(len(own)))
        return pa.table([own[moved].view(np.int64), own[label[moved]].view(np.int64)], schema=_EDGE)

    return run


def _members(batches):
    for b in batches:
        for body in b.column("body"):
            cls, group, n = X.unpack(memoryview(body.as_buffer()), (U64, U64, np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(group.view(np.int64)), pa.array(n.astype(np.int64))], names=["lo", "grp", "n"])


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets just as all links would: each set found is compared with all not yet found.

    A comparison reads the posting lists of the set's own shingles; the lists are built again when half of
    their sets have been found, so a large group of copies is read about twice and not once for each member.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    n_ids = int(ids.max()) + 1 if len(ids) else 0
    free = np.ones(len(sets), bool)
    indexed = 0
    out, queue = [], []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        queue.append(seed)
        while queue:
            left = int(free.sum())
            if not left:
                return out
            if not indexed or left * 2 < indexed:
                member = np.repeat(free, sizes)
                token, own = ids[member], np.repeat(np.arange(len(sets)), sizes)[member]
                order = np.argsort(token, kind="stable")
                own = own[order]
                first = np.searchsorted(token[order], np.arange(n_ids + 1))
                indexed = left
            p = queue.pop()
            mine = ids[ends[p] - sizes[p] : ends[p]]
            a, c = first[mine], first[mine + 1] - first[mine]
            at = np.repeat(a - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            near, common = np.unique(own[at], return_counts=True) if len(at) < len(sets) else (np.arange(len(sets)), np.bincount(own[at], minlength=len(sets)))
            hit = free[near] & (100 * common >= percent * (sizes[p] + sizes[near] - common))
            got = near[hit]
            free[got] = False
            out += [(p, i) for i in got.tolist()]
            queue += got.tolist()
    return out


def _verify(size: int, percent: int):
    @lean
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("lo", "ascending")])
        comp = table.column("comp").to_numpy()
        ids = table.column("lo").to_numpy()
        sets = shingle_sets(table.column("text"), size)
        own = np.array([fingerprint(s)[0] for s in sets], U64).view(np.int64) == ids
        cuts = [0, *(np.flatnonzero(np.diff(comp)) + 1).tolist(), len(comp)]
        u, v = [], []
        for a, b in zip(cuts, cuts[1:]):
            # the rows of an id may have other texts, or one text twice
            some = [i for i in range(a, b) if own[i] and len(sets[i])]
            some = [i for n, i in enumerate(some) if not n or ids[i] != ids[some[n - 1]]]
            if len(some) > 1:
                for x, y in linked([sets[i] for i in some], percent):
                    u.append(ids[some[x]])
                    v.append(ids[some[y]])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGE)

    return run


def _connected(posted: DataFrame, classes: DataFrame, percent: int, least, parts: int, scratch: Scratch, name: str) -> DataFrame:
    """(lo, n, comp) of the classes that posted shingles leave as candidates; comp: those that may be linked, at once or by others."""
    shared = X.reduce(posted, parts, (U64, U64), _frequencies(parts), X.BLOB)
    kinds = scratch.table(X.reduce(shared.union(classes.select("lo", "n").mapInArrow(_class_blobs(parts), X.BLOB)), parts, (U64, U64, np.uint32), _groups(least, parts), "kind int, part int, body binary"), f"{name}-groups")
    pairs = X.reduce(kinds.where("kind = 1").select("part", "body"), parts, (U64, U64, np.uint32, np.uint32), _pairs(percent, least), "u long, v long")
    comps = scratch.table(components(pairs, scratch, name), f"{name}-found")
    members = kinds.where("kind = 0").select("body").mapInArrow(_members, "lo long, grp long, n long")
    return members.join(comps.select(F.col("node").alias("grp"), "component"), "grp", "left").select("lo", "n", F.coalesce("component", "grp").alias("comp"))


def _sizes(members: DataFrame, chunk: int) -> DataFrame:
    """(comp, k): the chunks that connected classes make, where there are two classes or more."""
    return members.groupBy("comp").agg(F.count("*").alias("m"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") + 32) / chunk)).cast("int").alias("k")).where("m > 1").drop("m")


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row (hash of the text), n, link_id (one for each set of linked texts; null without words or id), component_id, for each row."""
    spark = docs.sparkSession
    parts = parts_of(spark, docs)
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    info = scratch.table(base.withColumn("row", F.xxhash64("text")).mapInArrow(_info(size), "doc_id long, row long, n long, lo long, hi long"), "info")
    live = info.where("n > 0 and doc_id is not null")
    classes = scratch.table(live.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep")), "classes")
    posted = base.where("doc_id is not null").select("text").mapInArrow(_postings(size, percent, parts), X.BLOB)
    members = _connected(posted, classes, percent, lambda n: _extra(_least(n, percent), percent), parts, scratch, "cand")
    reps = scratch.table(members.join(classes.select("lo", "n", "rep"), ["lo", "n"]).select("comp", "rep", "lo", "n"), "reps")
    scratch.drop("cand-groups", "cand-found")
    some = reps.join(_sizes(reps, chunk), "comp").select("comp", "rep", "lo", "n", "k")
    texts = scratch.table(base.join(some.hint("merge"), F.col("doc_id") == F.col("rep")).select("comp", "lo", "n", "k", "text"), "texts")
    sent = texts.where("k = 1").select("comp", "lo", "text", F.pmod(F.xxhash64("comp"), F.lit(parts)).alias("bin"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    large = texts.where("k > 1")
    if not large.isEmpty():
        posted = large.select("comp", "lo", "text").mapInArrow(_whole_postings(size, parts), X.BLOB)
        members = scratch.table(_connected(posted, large.select("lo", "n").distinct(), percent, lambda n: np.maximum(_least(n, percent), 1), parts, scratch, "whole"), "members")
        scratch.drop("whole-groups", "whole-found")
        cut = members.join(_sizes(members, chunk), "comp").withColumn("c", F.pmod(F.xxhash64("lo"), F.col("k")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
            "comp", "lo",
            F.when(F.col("k") == 1, F.pmod(F.xxhash64("comp"), F.lit(parts))).otherwise(F.col("comp")).alias("bin"),
            F.when(F.col("k") == 1, -1).otherwise(F.least("c", "o")).alias("i"),
            F.when(F.col("k") == 1, -1).otherwise(F.greatest("c", "o")).alias("j"),
        )
        sent = sent.union(large.select("lo", "text").join(cut.hint("merge"), "lo").select(sent.columns))
    links = sent.groupBy("bin", "i", "j").applyInArrow(_verify(size, percent), "u long, v long")
    found = scratch.table(components(links, scratch, "link"), "components")
    scratch.drop("reps", "texts", "members")
    # links are between texts; the smallest id of linked texts is looked up at the end
    least = found.join(classes, F.col("node") == F.col("lo")).groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "component")
    of = classes.join(found, F.col("lo") == F.col("node"), "left").select("lo", "hi", "n", F.coalesce("component", "lo").alias("link_id"), F.coalesce("component_id", "rep").alias("component_id"))
    keyed = info.join(of, ["lo", "hi", "n"], "left")
    known = F.col("doc_id").isNotNull()
    return keyed.select("doc_id", "row", "n", F.when(known, F.col("link_id")).alias("link_id"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included), for each row.

    size: words in a shingle. percent: least Jaccard similarity. chunk: size of a candidate set that one task
    verifies at once; larger sets are cut into chunks and every pair of chunks is verified.
    """
    return row_components(docs, id_col, text_col, size, percent, chunk).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB SQL; all pairs with a common shingle are counted.
OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(v) FROM reach WHERE u = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
