"""Substring dedup by seed and extend.

Method: every window of ``window`` words selects one anchor, the k-gram with the least hash
in it (winnowing), so equal windows select equal anchors at equal offsets. An anchor
is stored with the hash of its reach: all words of the windows that chose it.
Documents meet on equal anchors (seeds). Equal reaches are repeats of full
extent in both directions. Where equal
anchors have unequal reaches, a repeat ends nearby, and it is extended word by
word: the windows of one representative of each distinct reach are compared. Runs that touch
or overlap are then joined to maximal repeats: stretches of a document every window of which
occurs elsewhere, and that no neighbouring window prolongs. Maximal repeats are removed.

Cost: anchors are about 2 / (window - k + 2) of the words, and only repeats' ends are
looked at window by window, so shuffles stay well below the texts' size. A passage in
a third of all documents has that many equal reaches, which a partial aggregate
folds; no group is gathered and no pairs are listed. Hashes are compared as 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 35
ANCHOR = 8
#: Distinct words a worker remembers the hashes of.
CACHE = 500_000
_REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """Powers of the two bases and of their inverses modulo 2 ** 64."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> None:
        if n <= self.n:
            return
        n = max(n, 2 * self.n, 4096)
        self.up, self.down = [], []
        for base in _BASES:
            for out, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
        self.n = n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Text:
    """Words of one text with range hashes in constant time."""

    def __init__(self, words: list[bytes], hashes: _Hashes, powers: _Powers) -> None:
        self.n = len(words)
        powers.upto(self.n + 1)
        self.powers = powers
        x = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: self.n], dtype=np.uint64)]) for up in powers.up]

    def span(self, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        """A 64-bit hash of the words in [lo, hi), for arrays of ranges."""
        s = self.sums[which]
        return _mix((s[hi] - s[lo]) * self.powers.down[which][lo])

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, reach hash, first window start, last window start)."""
        if self.n < window:
            e = np.zeros(0, np.int64)
            return e.astype(np.uint64), e.astype(np.uint64), e, e
        g = np.arange(self.n - k + 1)
        h = self.span(g, g + k, 0)
        width = window - k + 1
        at = _sliding_argmin(h, width)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        pos = at[first]
        reach = self.span(first, last + window, 1)
        shape = ((last - first) * 64 + (pos - first)).astype(np.uint64)
        return h[pos], _mix(reach ^ (shape * np.uint64(_BASES[0]))), first, last


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """The rightmost least element of each run of ``width`` elements, by doubling."""
    n = len(h)
    idx = np.arange(n)
    span = 1
    while span * 2 <= width:
        a, b = idx[: len(idx) - span], idx[span:]
        idx = np.where(h[b] <= h[a], b, a)
        span *= 2
    if span < width:
        shift = width - span
        a, b = idx[: len(idx) - shift], idx[shift:]
        idx = np.where(h[b] <= h[a], b, a)
    return idx


def split_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchor_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1).to_numpy(), b.column(2)
            parts, rows = [], []
            for i in range(b.num_rows):
                words = split_words(texts[i].as_py())
                if len(words) < window:
                    continue
                a = _Text(words, hashes, powers).anchors(window, k)
                parts.append((a[0].view(np.int64), a[1].view(np.int64), a[2] * 64 + (a[3] - a[2])))
                rows.append(np.full(len(a[0]), i))
            if parts:
                h, reach, pack = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(keys[row]), pa.array(h), pa.array(reach), pa.array(pack)], names=["doc_id", "key", "h", "reach", "pack"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for b in batches:
            ids, keys, texts, wanted = (b.column(i) for i in range(4))
            keys = keys.to_numpy()
            parts, rows = [], []
            for i in range(b.num_rows):
                text = _Text(split_words(texts[i].as_py()), hashes, powers)
                want = wanted[i].values
                h, n, pack = (want.field(f).to_numpy() for f in ("h", "n", "pack"))
                first, count = pack // 64, pack % 64 + 1
                which = np.repeat(np.arange(len(h)), count)
                start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                parts.append((h[which], text.span(start, start + window, 1).view(np.int64), start, n[which]))
                rows.append(np.full(len(which), i))
            if parts:
                h, w, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(keys[row]), pa.array(h), pa.array(w), pa.array(start), pa.array(n)], names=["doc_id", "key", "h", "w", "start", "n"])

    return run


def maximal(packs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, ends) of the maximal repeats of a document, from its runs of repeated windows.

    Runs whose windows follow each other without a gap are one repeat; others stay apart, even
    where their words overlap.
    """
    start = packs // 64
    order = np.argsort(start, kind="stable")
    start, last = start[order], np.maximum.accumulate((start + packs % 64)[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > last[:-1] + 1])) if len(start) else np.zeros(0, int)
    return start[fresh], last[np.append(fresh[1:], len(start)) - 1] + window if len(start) else start


def _removal_rows(window: int, names: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, packs = b.column(len(names)), b.column(len(names) + 1)
            n_words, n_removed, sha, kept, repeats = [], [], [], [], []
            for i in range(b.num_rows):
                words = split_words(texts[i].as_py())
                n = len(words)
                repeats.append([])
                if packs[i].is_valid:
                    first, end = maximal(packs[i].values.to_numpy(), window)
                    repeats[-1] = [{"start": a, "length": b - a} for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, end, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                rest = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode("utf-8", "surrogatepass"))
            cols = [b.column(i) for i in range(len(names))] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            more = [pa.array(repeats, _REPEATS), pa.array(kept, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(cols + more, names=names + ["n_words", "n_removed", "kept_sha256"] + ["repeats", "kept_text"] * with_text)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``doc_id, key, pack``: start * 64 + (windows - 1) of runs of repeated windows.

    ``docs`` has ``doc_id, key, text``. Every repeated window lies in such a run and every
    window of a run is repeated.
    """
    if not 1 <= k <= window < 64 + k - 1:
        raise ValueError("need 1 <= k <= window, and at most 64 windows an anchor")
    keyed = F.col("doc_id"), F.col("key")
    ident = docs.schema["doc_id"].dataType.simpleString()
    anchors = docs.select(*keyed, "text").mapInArrow(_anchor_rows(window, k), f"doc_id {ident}, key long, h long, reach long, pack long")
    anchors = materialize(anchors, "sub-anchors")
    reaches = anchors.groupBy("h", "reach").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("pack").alias("pack"))
    reaches = materialize(reaches, "sub-reaches")
    # anchors of several reaches: a repeat ends near them
    ends = reaches.groupBy("h").agg(F.count("*").alias("reaches")).where("reaches > 1").select("h")
    ends = reaches.join(ends, "h")
    wanted = ends.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "n", "pack")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc_id": "w_doc_id", "key": "w_key"})
    # rows repeated in full give their windows twice, but then these count over 1 by their reach alone
    texts = docs.join(wanted, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_doc_id")))
    windows = texts.select(*keyed, "text", "wanted").mapInArrow(_window_rows(window), f"doc_id {ident}, key long, h long, w long, start long, n long")
    windows = materialize(windows, "sub-windows")
    twice = windows.groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "w")
    single = windows.where("n = 1").join(twice, ["h", "w"], "left_semi").select(*keyed, (F.col("start") * 64).alias("pack"))
    full = anchors.join(reaches.where("n > 1").select("h", "reach"), ["h", "reach"], "left_semi").select(*keyed, "pack")
    return full.union(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """The documents' ``doc_id, n_words, n_removed, kept_sha256`` and, if wanted, ``repeats, kept_text``.

    ``repeats`` has the maximal repeats, by first word and length in words, in order.

    A word goes if any window of ``window`` words over it also starts elsewhere, in
    another document or the same one; all windows are judged on the input.

    Defined cases: a null text has no words; shorter texts than the window lose none;
    repeated rows are documents of their own, so they repeat each other; a null id is
    an id like others; extra columns are ignored; an empty table gives none.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    packs = repeated_ranges(d, window, k).groupBy("doc_id", "key").agg(F.collect_set("pack").alias("packs"))
    packs = packs.withColumnsRenamed({"doc_id": "p_doc_id", "key": "p_key"})
    joined = d.join(packs, (F.col("key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("p_doc_id")), "left").select("doc_id", "text", "packs")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", repeats array<struct<start:long,length:long>>, kept_text string" * with_text
    return joined.mapInArrow(_removal_rows(window, ["doc_id"], with_text), schema)


def op3_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), w AS (
  SELECT rid, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), r AS (
  SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r
), g AS (
  SELECT rid, count(*) AS n, list(p) AS ps FROM gone GROUP BY rid
), each AS (
  SELECT d.rid, d.words[p] AS word, p FROM (SELECT rid, unnest(range(1, len(words) + 1)) AS p FROM d) JOIN d USING (rid)
  ANTI JOIN gone USING (rid, p)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM each GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
"""
