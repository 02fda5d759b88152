"""Token ids in files of fixed-width bits, with block offsets for random access.

A file: the header MAGIC, then int64 counts (bits, documents, ids, blocks, ids in a block), int64 document ids, a
byte for each that says it is null, int64 ids of each document, int64 byte offsets of the blocks, and the blocks. A block holds BLOCK_IDS ids at
``bits`` bits each, low bit first, padded to a byte; any run of ids is read from its blocks alone.

Tokenizing: where the tokenizer's own configuration says that its words never span white space, each distinct space-free chunk (less a full stop or
comma at its end, which the tokenizer cuts off) is encoded once by the tokenizers library and documents are put together from chunk ids in numpy; other
tokenizers encode whole texts.

Documents are range-partitioned by id, so files follow each other in ascending id order; a task's files count
only if the manifest names them, so repeated or lost tasks leave no trace. Defined cases: null and empty texts
have only the end id; rows that share an id follow each other by text; a null id comes first; an empty table has no file;
other columns are ignored; a very long document may fill a file of its own.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.shared import Scratch, filesystem, parts_of, put
from attesta.llm.textarrays import U64, mix64, slices, text_bytes, word_hashes, words

MAGIC = b"ATTBITS1"
BLOCK_IDS = 1 << 16
FILE_IDS = 4_000_000
SLICE = 1 << 20
CACHE_WORDS = 1_000_000
END_ID = 2


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(body: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(body, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def file_pieces(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    blocks = [pack_bits(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + np.array([bits, len(doc_ids), len(ids), len(blocks), BLOCK_IDS], np.int64).tobytes()
    head += np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + null.tobytes() + counts.astype(np.int64).tobytes()
    offsets = len(head) + 8 * len(blocks) + np.cumsum(sizes) - sizes
    return [head, offsets.astype(np.int64).tobytes(), *blocks]


class TokenFile:
    """Reads a file: document table at once, ids by range."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        head = self.file.read(48)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.bits, docs, self.n_ids, blocks, self.block_ids = np.frombuffer(head, np.int64, 5, 8).tolist()
        rest = self.file.read(docs * 17 + blocks * 8)
        null = np.frombuffer(rest, np.uint8, docs, 8 * docs).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(rest, np.int64, docs), mask=null)
        self.counts = np.frombuffer(rest, np.uint8, 8 * docs, 9 * docs).view(np.int64) if docs else np.zeros(0, np.int64)
        self.offsets = np.frombuffer(rest, np.uint8, 8 * blocks, 17 * docs).view(np.int64) if blocks else np.zeros(0, np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block_ids, (start + n - 1) // self.block_ids + 1):
            held = min(self.block_ids, self.n_ids - b * self.block_ids)
            got = unpack_bits(self.file.read_at(-(-held * self.bits // 8), int(self.offsets[b])), self.bits, held)
            out.append(got[max(0, start - b * self.block_ids) : start + n - b * self.block_ids])
        return np.concatenate(out)


_TAIL, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[[44, 46]] = True
_ALPHA[65:91] = _ALPHA[97:123] = True


#: Steps that never look beyond white space, and leave out what is white.
LOCAL_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
_PROBE = " a  b\tc\n d,e  "


def words_end_at_spaces(config: dict) -> bool:
    """Whether no token of a tokenizer (its own JSON) may hold or depend on white space, so that space-free chunks may be encoded apart.

    The first step that cuts must drop white space: one of SPLITTERS, or a pattern that removes all but its matches and matches none of it. Normalizers
    must be local; of replacements only white space by a space is. Anything else is encoded text by text.
    """
    steps = lambda part, name: [] if part is None else part[name] if part["type"] == "Sequence" else [part]
    for n in steps(config.get("normalizer"), "normalizers"):
        blank = n["type"] == "Replace" and n.get("content") == " " and n.get("pattern", {}).get("Regex") in (r"\s+", r"\s")
        if n["type"] not in LOCAL_NORMALIZERS and not blank:
            return False
    cutters = steps(config.get("pre_tokenizer"), "pretokenizers")
    if not cutters:
        return False
    first = cutters[0]
    if first["type"] == "Split":
        import regex

        pattern = first["pattern"].get("Regex")
        return bool(pattern) and first["behavior"] == "Removed" and bool(first["invert"]) and not any(x.isspace() for m in regex.finditer(pattern, _PROBE) for x in m.group())
    return first["type"] in SPLITTERS


class ChunkTokenizer:
    """Ids of whole texts from the ids of their distinct chunks.

    Known chunks are a sorted hash array with places in one flat id array, emptied when CACHE_WORDS are held. New chunks are
    encoded many in one call, kept apart by a special token, which the library cuts out before anything else.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = [(i, t) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_text = (special[0][0], special[0][1].content) if special else (None, "")
        say = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.by_chunk = words_end_at_spaces(json.loads(self.tokenizer.to_str()))
        #: Of these properties of the tokenizer fewer distinct chunks come; both are looked up, not assumed.
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZaz") == "azaz"
        self.cuts_tail = all(say(w + e) == say(w) + say(e) for w in ("a", "word", "it's", "l'été", "x1y") for e in ".,")
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.flat, self.first, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and the number of each."""
        plain = np.array([self.mark is not None and "<" not in c for c in chunks], bool)
        lens = np.zeros(len(chunks), np.int64)
        out: list = [None] * len(chunks)
        at = np.flatnonzero(plain)
        pieces = []
        for a in range(0, len(at), 4096):
            some = at[a : a + 4096]
            ids = np.array(self.tokenizer.encode(self.mark_text.join([chunks[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            lens[some] = np.diff(np.r_[-1, cut, len(ids)]) - 1
            pieces.append(np.delete(ids, cut))
        joined = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        if len(at) == len(chunks):
            return joined, lens
        ends = np.cumsum(lens[at])
        for i, e in zip(at, ends):
            out[i] = joined[e - lens[i] : e]
        for i in np.flatnonzero(~plain):
            out[i] = np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, np.uint32)
            lens[i] = len(out[i])
        return np.concatenate(out), lens

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if not self.by_chunk:
            got = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)
        raw, offs = text_bytes(texts)
        starts, ends, rows = words(raw, offs)
        n = len(offs) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if self.cuts_tail:  # a full stop or comma after a letter is a chunk of its own
            tail = np.flatnonzero(_TAIL[raw[ends - 1]] & (ends - starts > 1) & _ALPHA[raw[np.maximum(ends - 2, 0)]])
            starts, rows, last = np.insert(starts, tail + 1, ends[tail] - 1), np.insert(rows, tail + 1, rows[tail]), ends[tail]
            ends = ends.copy()
            ends[tail] -= 1
            ends = np.insert(ends, tail + 1, last)
        h = word_hashes(raw, starts, ends, exact=not self.lowers)
        if self.lowers and (mark := raw == 60).any():  # with "<" a special token may be spelt, and its case counts
            odd = np.flatnonzero(np.add.reduceat(mark, starts))
            h[odd] = mix64(word_hashes(raw, starts[odd], ends[odd], exact=True))
        one, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        place = np.searchsorted(self.hash, one)
        known = place < len(self.hash)
        known[known] = self.hash[place[known]] == one[known]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            ids, lens = self._encode_new([data[starts[i] : ends[i]].decode("utf-8", "replace") for i in at[new]])
            slot = len(self.lens) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lens) - lens])
            self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])
            self.hash, self.slot = np.insert(self.hash, place[new], one[new]), np.insert(self.slot, place[new], slot)
            place = np.searchsorted(self.hash, one)
        word = self.slot[place][inverse]
        wl = self.lens[word]
        begin = np.cumsum(wl) - wl
        ids = self.flat[np.repeat(self.first[word] - begin, wl) + np.arange(int(wl.sum()), dtype=np.int64)]
        return ids, np.bincount(rows, weights=wl, minlength=n).astype(np.int64)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_at(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        t = tokenizer_at(tokenizer)
        bits = bits_for(max(t.vocabulary, end_id + 1))
        docs, counts, ids, held = [], [], [], 0

        def save():
            path = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.bits"
            put(path, file_pieces(docs, np.concatenate(counts), np.concatenate(ids), bits))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [len(docs)], "n_ids": [held]})

        for b in slices(batches, "text", SLICE):
            got, n = t.encode(b.column("text"))
            ends = np.cumsum(n)
            ids.append(np.insert(got, ends, end_id))
            counts.append(n + 1)
            docs += b.column("doc_id").to_pylist()
            held += len(ids[-1])
            if held >= file_ids:
                yield save()
                seq += 1
                docs, counts, ids, held = [], [], [], 0
        if docs:
            yield save()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, scratch: Scratch, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes all texts in ascending id order; returns the manifest: part, seq, path, n_docs, n_ids, start."""
    parts = parts_of(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = scratch.table(ordered.mapInArrow(_write(scratch.at("bits"), tokenizer, end_id, file_ids), _MANIFEST), "manifest")
    # a row for each file
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part", "seq")) - F.col("n_ids"))


def _digest(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            f = TokenFile(path)
            ends = np.cumsum(f.counts)
            crc = np.zeros(len(ends), np.int64)
            at = 0
            while at < len(ends):  # whole documents, about a few blocks at a time
                base = int(ends[at] - f.counts[at])
                to = max(at + 1, int(np.searchsorted(ends, base + 4 * BLOCK_IDS, "right")))
                data = memoryview(f.ids(base, int(ends[to - 1]) - base).astype("<u4").tobytes())
                for i in range(at, to):
                    crc[i] = zlib.crc32(data[4 * int(ends[i] - f.counts[i] - base) : 4 * int(ends[i] - base)])
                at = to
            yield pa.RecordBatch.from_arrays([f.doc_ids, pa.array(start + ends - f.counts), pa.array(f.counts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spread = manifest.select("path", "start").repartition(parts_of(manifest.sparkSession), "path")
    return spread.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_token_files(scratch.table(write_token_files(docs, tokenizer, scratch), "starts"))


def production_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_tokenizer())
