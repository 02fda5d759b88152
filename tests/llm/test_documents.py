"""Operators on documents against brute force, on awkward rows and at sf0.001."""

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import kneser_ney, ngram_join, suffix_dedup, token_files
from attesta.llm.mixing import poisson_mix

FOLD = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_ngram_join(documents, empty):
    def brute(rows):
        sets = []
        for _, text in rows:
            w = words(text)
            sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
        parent = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                i = parent[i]
            return i

        for a in range(len(rows)):
            for b in range(a):
                if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                    parent[y] = x
        return Counter((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets))

    assert Counter(map(tuple, ngram_join.ngram_jaccard_join(documents).collect())) == brute(pairs(documents))
    # chunks smaller than the candidate sets give the same components
    assert Counter(map(tuple, ngram_join.ngram_jaccard_join(documents, chunk=100).collect())) == brute(pairs(documents))
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_ngram_join_sends_no_text_for_a_shared_passage(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    passage = say(20)
    texts = [[*say(30), *passage, *say(30)] for _ in range(400)]
    near = [[*t[:-1], "other"] for t in texts[:10]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + near)], "doc_id long, text string")
    verify = ngram_join._verify

    def counted(size, percent):
        run = verify(size, percent)

        def count(table):
            (tmp_path / f"{uuid.uuid4().hex}").write_text(str(table.num_rows))
            return run(table)

        return count

    monkeypatch.setattr(ngram_join, "_verify", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs, chunk=5000).collect()}
    assert got == {k: k if k < 400 else k - 400 for k in range(410)}
    # 400 texts with one passage in common are several chunks, which would meet pair by pair
    assert 20 <= sum(int(f.read_text()) for f in tmp_path.iterdir()) < 410


@pytest.mark.parametrize("seed", range(3))
def test_linked_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(80):
        s = set(rng.integers(0, 4000, 40).tolist()) if not sets or rng.random() < 0.4 else set(list(sets[rng.integers(len(sets))])[int(rng.integers(0, 12)) :]) | set(rng.integers(0, 4000, 3).tolist())
        sets.append(s)

    def groups(edges):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = [(a, b) for a in range(80) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = ngram_join.linked([np.array(sorted(s), np.uint64) for s in sets], 75)
    assert groups(found) == groups(every)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(documents, empty, hot):
    def brute(rows, depth=200):
        count = Counter()
        for _, text in rows:
            b = (text or "").encode()
            count.update(b[s : s + depth] for s in range(len(b) - depth + 1))
        out = []
        for i, text in rows:
            b = (text or "").encode()
            gone = np.zeros(len(b), bool)
            for s in range(len(b) - depth + 1):
                if count[b[s : s + depth]] > 1:
                    gone[s : s + depth] = True
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return Counter(out)

    got = suffix_dedup.remove_repeats(documents, hot=hot)
    assert Counter(map(tuple, got.drop("kept").collect())) == brute(pairs(documents))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(documents, order):
    got = {(r.doc_id, r.n_tokens, r.n_known): (r.held_out, r.train_tokens, r.base_score, r.score) for r in kneser_ney.score_documents(documents, order=order).collect()}
    rows = [(i, [*words(t), None]) for i, t in pairs(documents)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [w for (_, w), h in zip(rows, held) if not h]
    count = Counter(t for w in train for t in w)
    total, types = sum(count.values()), len(count)
    grams = {order: Counter(tuple((["<s>"] * (order - 1) + w)[k : k + order]) for w in train for k in range(len(w)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in grams}
    for k in grams:
        for g, c in grams[k].items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][min(c, 3)] += 1
    d = {k: kneser_ney.discounts([sum(c == n for c in grams[k].values()) for n in (1, 2, 3, 4)]) for k in grams}

    def p(g):
        out = 1 / (types + 1)
        for k in range(1, order + 1):
            s = g[order - k :]
            n = context[k].get(s[:-1])
            if n:
                c = grams[k].get(s, 0)
                out = max(c - d[k][min(c, 3)], 0) / n[0] + sum(d[k][j] * n[j] for j in (1, 2, 3)) / n[0] * out
        return out

    h = next(iter(context[order]))
    assert sum(p((*h, w)) for w in count) + p((*h, "unseen")) == pytest.approx(1)
    for (i, w), out in zip(rows, held):
        a = got[(i, len(w), sum(t in count for t in w))]
        assert a[:2] == (out, total)
        assert a[2] == pytest.approx(sum(math.log10((count.get(t, 0) + 0.1) / (total + 0.1 * (types + 1))) for t in w))
        padded = ["<s>"] * (order - 1) + w
        assert a[3] == pytest.approx(sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(w))))


def test_kneser_ney_without_training(spark, empty):
    assert kneser_ney.score_documents(empty).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = kneser_ney.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)


def test_token_files(documents, empty):
    from tokenizers import Tokenizer

    path = token_files.production_tokenizer()
    t = Tokenizer.from_file(path)
    at, want = 0, []
    for i, text in sorted(pairs(documents), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, token_files.encode_documents(documents, path).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 150_001, dtype=np.uint64).astype(np.uint32)
    (tmp_path / "f").write_bytes(b"".join(token_files.file_pieces([5, None], np.array([150_000, 1]), ids, bits)))
    f = token_files.TokenFile(str(tmp_path / "f"))
    assert f.doc_ids.to_pylist() == [5, None] and f.counts.tolist() == [150_000, 1]
    for start, n in ((0, 150_001), (65_530, 20), (149_999, 2), (3, 0)):
        assert (f.ids(start, n) == ids[start : start + n]).all()


def test_chunks_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_files.production_tokenizer()
    t, chunks = Tokenizer.from_file(path), token_files.ChunkTokenizer(path)
    texts = ["a b c", "don't IT'S\n\n'S 12 3 z.", "<|endoftext|>b<|STARTOFTEXT|> <|startoftext|>.", "İstanbul ſ ﬁ", "x\x1cy \x85q", "日本 語,", "a\x00b.,", "é. é.", "", "l'été, x."]
    for x in texts:
        assert chunks.encode(pa.array([x]))[0].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_poisson_mix(documents, empty):
    got = poisson_mix(documents).cache()
    per = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(per) <= {"a", "b", "c", None}
    # copies are numbered from 1 and rows of one id agree
    assert got.groupBy("doc_id", "text", "mix_copies").agg(F.max("mix_copy").alias("m"), F.count("*").alias("n")).where("m <> mix_copies or n % mix_copies <> 0").count() == 0
    assert got.select("mix_key").distinct().count() <= got.count()
    assert poisson_mix(empty).count() == 0
    only = poisson_mix(documents, weights={"a": 1.0})
    assert {r.source for r in only.where("length(text) > 0").select("source").distinct().collect()} == {"a"}


def test_poisson_mix_reaches_the_rates(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    n = {r.source: r["count"] for r in poisson_mix(docs, weights={"x": 3.0, "y": 1.0}).groupBy("source").count().collect()}
    # x: 30,000 of 10,000 rows, so 3 of each; y: 10,000 of 30,000
    assert abs(n["x"] - 30_000) < 700 and abs(n["y"] - 10_000) < 500
    n = poisson_mix(docs.limit(4_000), weights={"x": 1.0}).where("source = 'x'").count()
    assert abs(n - 4_000) < 300
    many = poisson_mix(docs.where("doc_id < 400").withColumn("source", F.when(F.col("doc_id") == 0, "x").otherwise("y")), weights={"x": 1.0})
    assert 300 < many.count() < 500  # a rate of 400 is a sum of draws
