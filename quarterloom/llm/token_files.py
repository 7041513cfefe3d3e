"""Token ids in binary files with a shared zstandard dictionary.

Method: a dictionary is trained on the serialized id arrays of a bounded sample of
documents. Every document's ids are compressed separately with it, so that one short
document can be read by itself. Files hold the dictionary's hash; the index holds
each document's file, byte offset, length, first token and token count.

File format (little-endian)
    header: b"QLTK", u16 version, u16 bytes an id, 32 bytes SHA-256 of the dictionary
    then:   one zstandard frame a document, in ascending doc_id order
Dictionary file: the dictionary's bytes, named by their hash.
Index: a table ``doc_id, key, shard, file, offset, length, start, n_tokens``.

Documents are range-partitioned by id, one file a partition. A retried or speculative task
writes a file of another name and the index, committed by Spark, names the files that count.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, least_hashed, materialize, release_memory

MAGIC, VERSION = b"QLTK", 1
HEADER = "<4sHH32s"
HEADER_SIZE = struct.calcsize(HEADER)
#: The sample that the dictionary is trained on: so many documents, by hash of the id.
SAMPLE_DOCS = 2000
#: What the dictionary sees of each of them: a piece of so many ids, from a place that its hash picks in the whole text.
SAMPLE_IDS = 4096
DICT_BYTES = 64 * 1024
LEVEL = 3
#: Pieces of text whose ids a worker remembers.
CACHE = 600_000
#: Documents that are encoded at once.
ENCODED = 600
END_ID = 0
#: How a byte-level vocabulary writes a space.
SPACE = "\u0120"
#: Pieces that may be encoded next to each other: a space at most, then visible ASCII or U+00C0..U+00FF.
_PLAIN = re.compile(r" ?[!-~\u00C0-\u00FF]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[33:127] = _GRAPHIC
    kinds[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTER
    kinds[32], kinds[10], kinds[0xC3] = _SPACE, _LINE, _LEAD
    kinds[0x80:0xC0] = _TAIL
    kinds[[0x97, 0xB7]] = 0
    return kinds


_GRAPHIC, _MARK, _LETTER, _SPACE, _LINE, _LEAD, _TAIL = range(1, 8)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in order, number of the text each belongs to).

    Cuts are where a byte-level BPE starts a pre-token in any context: before a space that
    a visible character follows; between a letter and an ASCII mark (other than the
    apostrophe, which may begin a contraction); around a single line feed between visible
    characters. Visible characters and letters here are ASCII and U+00C0..U+00FF; near
    others there is no cut, so their pieces are longer.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    first = (offsets - lo).astype(np.int64)
    kind = _byte_kinds()[data]
    visible = ((kind >= _GRAPHIC) & (kind <= _LETTER)) | (kind == _LEAD)  # as a first byte
    letter = kind == _LETTER
    if len(data):
        letter[1:] |= (kind[1:] == _TAIL) & (data[:-1] == 0xC3)
    seen = ((kind >= _GRAPHIC) & (kind <= _LETTER)) | letter  # as a last byte
    after, before = np.append(visible[1:], False), np.append(False, seen[:-1])
    inner = first[(first > 0) & (first < len(data))]
    after[inner - 1] = False
    before[inner] = False
    cut = (kind == _SPACE) & after
    cut[1:] |= letter[:-1] & (kind[1:] == _MARK)
    line = (kind == _LINE) & before & after
    cut |= line
    cut[1:] |= line[:-1]
    cut[inner] = True
    if len(data):
        cut[0] = True
    at = np.flatnonzero(cut)
    own = np.searchsorted(first, at, side="right") - 1
    ends = np.append(at, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())), own


class Encoder:
    """The tokenizer, with the ids of pieces it has met remembered.

    Texts are cut where pre-tokens begin in any context (``chunks_of``), so the pieces'
    ids, joined, are the text's. Arrow finds the distinct pieces, Python looks those up,
    new ones are encoded many to a string, and numpy lays out the ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.begins = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.begins[i] = token.startswith(SPACE)
        self.tokens = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.line = np.array(self._ids(["\n"])[0], dtype=self.dtype)
        self.by_piece = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None and len(self.line) == 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_many(self, pieces: list[str], space: bool) -> None:
        """Remember pieces of visible characters that all begin with a space, or that all don't."""
        width = self.dtype.itemsize
        for lo in range(0, len(pieces), 8192):
            part = pieces[lo : lo + 8192]
            strings = [("" if space else "\n").join(part[k : k + 64]) + ("" if space else "\n") for k in range(0, len(part), 64)]
            ids = np.array(list(chain.from_iterable(self._ids(strings))), dtype=self.dtype)
            if space:
                first = np.flatnonzero(self.begins[ids])
                last = np.append(first[1:], len(ids))
            else:
                last = np.flatnonzero(ids == self.line[0])
                first = np.append(0, last + 1)[:-1]
            if len(first) != len(part):
                self._learn_each(part)
                continue
            raw = ids.tobytes()
            self.seen.update(zip(part, map(raw.__getitem__, map(slice, (first * width).tolist(), (last * width).tolist())), strict=True))

    def _learn_each(self, pieces: list[str]) -> None:
        for p, x in zip(pieces, self._ids(pieces), strict=True):
            self.seen[p] = np.array(x, dtype=self.dtype).tobytes()

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        got = list(map(self.seen.get, pieces))
        if None in got:
            new = [p for p, x in zip(pieces, got, strict=True) if x is None]
            odd = [p for p in new if not _PLAIN.fullmatch(p)]
            self._learn_many([p for p in new if p[0] == " " and _PLAIN.fullmatch(p)], True)
            self._learn_many([p for p in new if p[0] != " " and _PLAIN.fullmatch(p)], False)
            self._learn_each(odd)
            got = list(map(self.seen.__getitem__, pieces))
        return got

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by END_ID; how many each text has)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_piece:
            ids = [[*x, END_ID] for x in self._ids(texts.to_pylist())]
            return np.array(list(chain.from_iterable(ids)), dtype=self.dtype), np.array([len(x) for x in ids], dtype=np.int64)
        whole = pa.array(np.zeros(len(texts), dtype=bool))
        for token in self.tokens:  # a string of the vocabulary's own is one id: such texts aren't cut
            whole = pc.or_(whole, pc.match_substring(texts, token))
        if pc.any(whole).as_py():
            ids, n = self.encode(pc.if_else(whole, "", texts))
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.array([*self._ids([texts[i].as_py()])[0], END_ID], dtype=self.dtype)
            return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        pieces, doc = chunks_of(texts)
        coded = pieces.dictionary_encode()
        table = [*self._known(coded.dictionary.to_pylist()), np.array([END_ID], dtype=self.dtype).tobytes()]
        size = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        # the end id behind each text's pieces, also where there are none
        ends = np.searchsorted(doc, np.arange(len(texts)), side="right")
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(table) - 1)
        length = size[codes]
        total = np.cumsum(length)
        ids = np.frombuffer(b"".join(table), dtype=self.dtype)[np.repeat(start[codes] - (total - length), length) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[ends + np.arange(len(texts))], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process: tasks of the same worker share what it has learnt."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, sample: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from the ids of ``sample`` documents with the least hashes of their ids.

    Empty if there are too few to train one; then frames are compressed without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids, n = enc.encode(b.column(0))
            at = b.column(1).to_numpy().view(np.uint64) % np.maximum(-(-n // SAMPLE_IDS), 1).astype(np.uint64)
            pieces = [x[k * SAMPLE_IDS : (k + 1) * SAMPLE_IDS].tobytes() for x, k in zip(np.split(ids, np.cumsum(n)[:-1]), at.astype(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["ids"])

    hashed = docs.select("text", F.xxhash64("doc_id", "key", F.lit(8)).alias("h"), "key")
    some = least_hashed(hashed, "h", sample, ("key",)).select("text", F.xxhash64("key").alias("h"))
    rows = [bytes(r["ids"]) for r in some.mapInArrow(run, "ids binary").collect()]
    rows.sort()
    if len(rows) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``doc_id, text`` documents to ``folder`` and return the index as a table.

    Defined cases: a null text is empty and has the end id alone; a null doc_id sorts
    first; equal ids sort by a hash of id and text, and rows repeated in full stay next to each other;
    extra columns are ignored; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    trained = train_dictionary(d, tokenizer)
    digest = hashlib.sha256(trained).digest()
    fs, base = _open_fs(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(posixpath.join(base, f"{digest.hex()}.zdict")) as f:
        f.write(trained)
    ident = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        to, at = _open_fs(folder)
        name, out, offset, start = f"{uuid.uuid4().hex}.tok", None, HEADER_SIZE, 0
        try:
            for b in batches:
                if out is None:
                    out = to.open_output_stream(posixpath.join(at, name))
                    out.write(struct.pack(HEADER, MAGIC, VERSION, enc.dtype.itemsize, digest))
                texts = b.column(2)
                for lo in range(0, b.num_rows, ENCODED):
                    part = b.slice(lo, ENCODED)
                    ids, n = enc.encode(texts.slice(lo, ENCODED))
                    raw, cut = ids.tobytes(), [0, *(np.cumsum(n) * enc.dtype.itemsize).tolist()]
                    frames = [comp.compress(raw[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    out.write(b"".join(frames))
                    length = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
                    offsets, starts = offset + np.cumsum(length) - length, start + np.cumsum(n) - n
                    offset, start = int(offset + length.sum()), int(start + n.sum())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([name] * part.num_rows), pa.array(offsets), pa.array(length), pa.array(starts), pa.array(n, pa.int64())], names=["doc_id", "key", "file", "offset", "length", "start_in_file", "n_tokens"])
        finally:
            if out is not None:
                out.close()
            release_memory()

    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    dealt = d.repartitionByRange(shards, *order) if shards else d.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    written = dealt.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {ident}, key long, file string, offset long, length long, start_in_file long, n_tokens long")
    index = materialize(written, "token-index")
    # files in order of their first document; the totals of as many rows as there are files
    files = index.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "key")).alias("lowest"), F.sum("n_tokens").alias("total"))
    w = Window.orderBy("lowest")
    files = files.select(F.col("file").alias("f_file"), (F.row_number().over(w) - 1).alias("shard"), (F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    index = index.join(files, F.col("file") == F.col("f_file"))
    return index.select("doc_id", "key", "shard", "file", "offset", "length", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, key, start, n_tokens, ids`` read back from the files; ids as u32 bytes."""
    return _read(index, folder, True)


def _read(index: DataFrame, folder: str, with_ids: bool) -> DataFrame:
    ident = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open_fs(folder)
        opened, name, dec, width = None, None, {}, 2
        try:
            for b in batches:
                files, offsets, lengths = b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy()
                crc, n, ids = [], [], []
                for f, o, k in zip(files, offsets, lengths, strict=True):
                    if f != name:
                        if opened is not None:
                            opened.close()
                        name, opened = f, fs.open_input_file(posixpath.join(at, f))
                        magic, version, width, digest = struct.unpack(HEADER, opened.read_at(HEADER_SIZE, 0))
                        if magic != MAGIC or version != VERSION:
                            raise ValueError(f"{f} is no token file of version {VERSION}")
                        if digest not in dec:
                            with fs.open_input_stream(posixpath.join(at, f"{digest.hex()}.zdict")) as z:
                                raw = z.read()
                            if hashlib.sha256(raw).digest() != digest:
                                raise ValueError(f"{f}: the dictionary's hash does not fit")
                            dec[digest] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
                    x = np.frombuffer(dec[digest].decompress(opened.read_at(int(k), int(o))), dtype=f"<u{width}").astype("<u4")
                    raw = x.tobytes()
                    crc.append(zlib.crc32(raw))
                    n.append(len(x))
                    if with_ids:
                        ids.append(raw)
                cols = [b.column(0), b.column(1), b.column(5), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=["doc_id", "key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        finally:
            if opened is not None:
                opened.close()

    rows = index.select("doc_id", "key", "file", "offset", "length", "start")
    return rows.mapInArrow(run, f"doc_id {ident}, key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the documents and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    folder = fresh_path(spark, "tokens")
    index = write_token_files(docs, folder)
    return _read(index, folder, False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
