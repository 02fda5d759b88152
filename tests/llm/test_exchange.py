"""Packed exchanges, hashes and the coding of n-grams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import exchange, kneser_ney, textarrays, token_files


def test_parts_fill_partitions(spark):
    n = 37
    rows = spark.range(1000).select((F.col("id") % n).cast("int").alias("part"), F.lit(b"x").alias("body"))

    def count(batches):
        parts = [p for b in batches for p in b.column("part").to_pylist()]
        yield pa.RecordBatch.from_pydict({"parts": pa.array([len(set(parts))], pa.int64())})

    assert [r.parts for r in exchange.deal(rows, n).mapInArrow(count, "parts long").collect()] == [1] * n


def test_parts_follow_the_input(spark, monkeypatch):
    from attesta.llm import shared

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = shared.parts_of(spark)
    assert shared.parts_of(spark, docs) == n == shared.parts_of(spark, spark.createDataFrame([("a",)], "text string"))
    monkeypatch.setattr(shared, "PART_BYTES", 1 << 10)
    assert shared.parts_of(spark, docs) > n


def test_order_of():
    rng = np.random.default_rng(1)
    for key in (rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 50, 5000).astype(np.uint64), np.zeros(0, np.uint64), np.array([3], np.uint64)):
        # hashes, and the worst there is: all leading bits equal
        assert (textarrays.order_of(key) == np.argsort(key, kind="stable")).all()


def test_word_hashes_do_not_depend_on_their_place():
    long = "w" * 200_000
    texts = ["b a", "A", f"x a {long} a", None, "", f"{long}", "\ta\n"]
    raw, offs = textarrays.text_bytes(pa.array(texts))
    starts, ends, rows = textarrays.words(raw, offs)
    found = [bytes(raw[a:e]).decode().lower() for a, e in zip(starts, ends)]
    want = [w.lower() for t in texts for w in (t or "").split()]
    assert found == want and rows.tolist() == [k for k, t in enumerate(texts) for _ in (t or "").split()]
    h = textarrays.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(set(want)) and len({(w, x) for w, x in zip(want, h.tolist())}) == len(set(want))


@pytest.mark.parametrize("width", [1, 3, 5])
def test_coded_grams(width):
    rng = np.random.default_rng(width)
    cols = [rng.integers(0, 1 << min(8 * width, 62), 300).astype(np.uint64) for _ in range(3)]
    for first in (np.sort(cols[0]), cols[0]):  # ascending as it is sent, and any
        c = rng.integers(1, 1000, 300)
        got, counts = kneser_ney.decode(kneser_ney.encode([first, *cols[1:]], c, width), 3, width)
        assert all((a == b).all() for a, b in zip(got, [first, *cols[1:]])) and (counts == c).all()


def test_shards(tmp_path):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    values = rng.integers(0, 600, len(keys))
    for whole in (False, True):
        kneser_ney.write_shard(f"file://{tmp_path}/x-{whole}", keys, [values], whole, np.arange(len(keys)))
        s = kneser_ney.Shard(np.fromfile(tmp_path / f"x-{whole}", np.uint8))
        at, hit = s.find(np.r_[keys, keys + np.uint64(1)])
        assert hit[: len(keys)].all() and (s.values(0, at[: len(keys)]) == values).all() and (s.extra[at[: len(keys)]] == np.arange(len(keys))).all()
        assert whole is False or not hit[len(keys) :].any()


def test_tokenizers_that_look_beyond_words(tmp_path):
    import public_tokenizers

    assert token_files.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_chunk
    t = token_files.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", " lead", None, "", "it\'s  two\n\nlines "]
    ids, n = t.encode(pa.array(texts))
    want = [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert not t.by_chunk and ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    for name, df in {"documents": empty.select("doc_id", "text", "lang", "source"), "benchmark": spark.createDataFrame([], "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
