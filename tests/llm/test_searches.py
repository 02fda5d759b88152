"""Chat formatting, embeddings, decontamination and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import chat, decontamination, embedding_dedup
from attesta.llm.components import components, local_labels
from attesta.llm.ngram_join import ngram_jaccard_join
from attesta.llm.queries import ORACLE_SQL, QUERIES
from attesta.llm.shared import Scratch


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "a<b<|im_end|>\\<\\|"), (1, 1, "user", None), (1, 2, "assistant", "<|im_start|>user\nhi<"), (1, None, None, "first"), (2, 5, "assistant", ""), (None, 0, "us%er<\n", "null id"),
        *[(3, k, "assistant" if k % 2 else "user", f"turn {k} é漢") for k in range(200)], (4, 0, "user", "b"), (4, 0, "user", "a"),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(chat.from_texts(turns)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in out.collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[conv] == ([(r[2] or "", r[3] or "") for r in mine], "".join(r[3] or "" for r in mine if r[2] == "assistant"))
    assert chat.format_chat(chat.from_texts(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda **k: tuple(k.get(n) for n in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [(1, 0, "user", [part(kind="text", text="look <"), part(kind="image", ref="i.png", width=56, height=30), part(kind="text", text="|x"), part(kind="audio", ref="a.wav", seconds=1.5)]), (1, 1, "assistant", [part(kind="document", ref="d.pdf", pages=2), part(text="odd")]), (1, 2, "user", None)]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r.formatted == "<|im_start|>user\nlook <\\<|image|>|x<|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>odd<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.turn, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [(0, "image", "i.png", 4), (0, "audio", "a.wav", 38), (1, "document", "d.pdf", 2048)]
    assert r.n_attachment_tokens == 4 + 38 + 2048
    s = r.loss_spans[0]
    assert r.formatted[s.start : s.start + s.length] == "<|document|>odd"


@pytest.mark.parametrize("chunk", [8192, 32])
def test_embedding_dedup(spark, chunk):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 20))
    x = (centers[rng.integers(0, 12, 300)] + 0.28 * rng.standard_normal((300, 20))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 20), (1002, [float("nan")] * 20), (1003, [1.0, None]), (1004, []), (1005, x[0].tolist()), (1006, x[0][:8].tolist()), (1007, [float("inf")] * 20), (1008, x[0].tolist()), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(df, chunk=chunk).collect()}
    y = np.vstack([x, x[:1], x[:1]]).astype(float)
    ids = [*range(300), 1005, 1008]
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = local_labels(len(ids), *np.nonzero(link))
    assert all(got[i] == (int(link[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids))
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1006, 1007)) and got[None] == (0, None, False)
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 16))
    near = [(a + 0.01 * rng.standard_normal(16)).tolist() for _ in range(2)]
    rows = [(5, a.tolist()), (5, b.tolist()), (6, near[0]), (7, near[1])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(5, 0, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5)]


def test_a_long_path_is_one_component(spark):
    n = 300
    df = spark.createDataFrame([(k, k + 1) for k in range(n)], "u long, v long")
    assert {r.component for r in components(df, Scratch(spark, "p")).collect()} == {0}


def test_settings_of_the_user_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "777")
    Scratch(spark, "s")
    assert spark.conf.get(key) == "777"
    spark.conf.unset(key)
    Scratch(spark, "s")
    assert spark.conf.get(key) == "2000"


def test_components(spark):
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = np.arange(1000, 1050)
    u, v = np.r_[u, chain[:-1], np.full(60, 2000)], np.r_[v, chain[1:], np.arange(2001, 2061)]
    df = spark.createDataFrame(pa.table({"u": u, "v": v}).to_pandas())
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    label = local_labels(3000, u, v)
    assert got == {int(i): int(label[i]) for i in set(u[u != v]) | set(v[u != v])}


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    items = [" ".join(word() for _ in range(n)) for n in rng.integers(8, 60, 30)]
    benchmark = spark.createDataFrame([(k, x) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (93, items[0])], "item_id long, text string")
    rows, want = [], {}
    for k in range(240):
        j = int(rng.integers(30))
        x = list(items[j])
        for _ in range(int(rng.integers(0, int(0.1 * len(x)) + 1))):
            p, how = int(rng.integers(len(x))), rng.integers(3)
            x[p : p + (how != 1)] = [] if how == 2 else [chr(97 + int(rng.integers(26)))]
        text = " ".join(word() for _ in range(60)) + " \n " + "".join(x).upper().replace(" ", "  ", 2) + " " + " ".join(word() for _ in range(60))
        rows.append((k, text))
        want[k] = j
    rows += [(500 + k, " ".join(word() for _ in range(200))) for k in range(40)] + [(600, None), (601, ""), (602, items[3]), (602, items[3]), (603, items[0])]
    got = decontamination.find_items(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, distance int"), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert np.mean([(k, j) in found for k, j in want.items()]) >= 0.95
    assert {i for i, _ in found if i >= 500} == {602, 603} and {(603, 0), (603, 93)} <= found
    assert sum(r.doc_id == 602 for r in got) == 1 and all(r.distance <= 0.1 * r.item_chars for r in got)
    assert all((i, j) in {(k, w) for k, w in want.items()} or want.get(i) == 0 or i >= 500 for i, j in found)


def test_decontamination_at_full_edits(spark):
    """Every copy with floor(L / 10) edits is found, at any length, with the distance and end of a search of the whole text."""
    rng = np.random.default_rng(8)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab, n))[:n].strip()
    items = [say(n) for n in (100, 300, 1000, 2500, 5000) for _ in range(2)]
    rows = []
    for j in range(len(items)):
        for _ in range(6):
            x = list(items[j])
            for _ in range(len(x) // 10):
                p, how = int(rng.integers(len(x))), rng.integers(3)
                x[p : p + (how != 1)] = [] if how == 2 else [chr(97 + int(rng.integers(26)))]
            rows.append((len(rows), " ".join(f"{say(400)} {''.join(x)} {say(400)}".split())))
    got = decontamination.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    codes = [[ord(c) for c in x] for x in items]
    masks = [decontamination.match_masks(np.array(x)) for x in codes]
    want = {(k, j, *decontamination.best_match(masks[j], len(codes[j]), [ord(c) for c in t])) for k, t in rows for j in range(len(items))}
    want = {w for w in want if w[2] <= len(items[w[1]]) // 10}
    assert {(k, k // 6) for k, _ in rows} == {w[:2] for w in want}
    assert {(r.doc_id, r.item_id, r.distance, r.end) for r in got} == want


def test_decontamination_of_short_items(spark):
    items = ["水の沸点は摂氏何度ですか？", "日本の首都はどこ？", "2 + 2 = ?", "Ω", " \n"]
    rows = [(0, f"問題。{items[0]}答え。"), (1, f"問題。{items[0].replace('沸', '融')}答え。"), (2, f"x{items[1]}y"), (3, "x日本の首都はどれ？y"), (4, "so 2  +\n2 = ?"), (5, "2 + 3 = ?"), (6, "an Ω and an Ω"), (7, "nothing at all")]
    got = decontamination.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(0, 0, 0), (1, 0, 1), (2, 1, 0), (4, 2, 0), (6, 3, 0)}
    got = decontamination.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), min_chars=13).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 0)}


def test_best_match():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return min(row)

    rng = np.random.default_rng(5)
    for _ in range(60):
        p, t = rng.integers(0, 3, rng.integers(1, 90)), rng.integers(0, 3, rng.integers(0, 120))
        assert decontamination.best_match(decontamination.match_masks(p), len(p), t.tolist())[0] == plain(p.tolist(), t.tolist())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Scratch(spark, "stage").table(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name == "benchmark_decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {r.doc_id for r in before.collect() if not any(x in " ".join(r.text.lower().split()) for x in items)}
            assert {r.doc_id for r in docs.collect()} == clean
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            mixed = docs
    assert sizes[0] == 200 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[4]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in docs.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_awkward_rows(spark, sf_dir, documents):
    docs = documents.withColumnRenamed("n", "n_chars")
    kept = Scratch(spark, "stage").table(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir), "x")
    assert kept.where("doc_id = 410").count() == 1 and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (100, 200)").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert hashlib.sha256(b"").hexdigest()  # the rows of the last stage are digests of files
    assert corpus_pipeline.write_tokens(spark, kept, sf_dir).count() == kept.count()


def test_contaminated_rows_without_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, f"a {item} b"), (None, "clean, no id"), (7, f"c {item}"), (7, "clean, same id"), (8, "clean"), (None, None), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r for r in rows if not (r[1] and item in r[1]))


def test_near_duplicates_with_shared_ids(spark, sf_dir):
    rng = np.random.default_rng(6)
    say = lambda: [f"w{k}" for k in rng.integers(0, 10**6, 60)]
    a, b, c, d = say(), say(), say(), say()
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(3, near(a)), (7, " ".join(a)), (7, " ".join(b)), (9, " ".join(c)), (9, near(c)), (9, " ".join(c).upper()), (9, " ".join(d)), (12, near(d)), (13, ""), (13, None), (13, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()]
    assert sorted(got) == sorted([(3, 56, 3), (7, 56, 3), (7, 56, 7), *[(9, 56, 9)] * 4, (12, 56, 9), *[(13, 0, 13)] * 3])
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    linked = {" ".join(c), near(c), " ".join(c).upper()}
    assert sum(n for (i, t), n in kept.items() if t in linked) == 1
    assert Counter({k: n for k, n in kept.items() if k[1] not in linked}) == Counter([(3, near(a)), (7, " ".join(b)), (9, " ".join(d)), (13, ""), (13, None)])


def test_near_duplicates_deal_texts_once(spark, documents, sf_dir):
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, sf_dir)
    dealt = [x for x in str(kept._jdf.queryExecution().executedPlan()).splitlines() if "Exchange hashpartitioning" in x]
    # repeated rows are found where the join left them, not by another exchange of whole texts
    assert dealt and not any("text#" in x.split("hashpartitioning")[1].split(")")[0] for x in dealt)
