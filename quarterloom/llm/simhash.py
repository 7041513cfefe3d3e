"""SimHash near-duplicates by the generalised pigeonhole principle.

Method: documents are reduced to 64-bit fingerprints and equal fingerprints to one
representative. Correlated bits are grouped into partitions (from the 64 x 64
co-occurrence counts of all fingerprints). If two fingerprints differ in at most
``tau`` bits, then for thresholds ``t_i`` with ``sum(t_i + 1) = tau + 1`` some partition i differs
in at most t_i bits; the thresholds may be unequal and -1 skips a partition. A
dynamic program picks the number of partitions and the thresholds with the least
estimated cost: probes plus candidates, the latter from the collision counts of all
fingerprints. Each fingerprint is stored under its partition values; the probe also
visits every value within t_i bits; pairs that meet are verified on all 64 bits.

Large meeting groups are cut into blocks and block pairs, which are separate cells of
bounded size, and a cell only emits a spanning forest of its links, so no group's
pairs are listed. Components come from alternating large-star and small-star
rounds. Nothing but 64 x 64 counts and per-partition totals reaches the driver.

``similar_documents`` asks for a Jaccard similarity of five-word shingles instead of a number
of bits. Pairs that the fingerprints propose come first; each is verified on the shingle
sets. At a similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average, beyond
what can be probed, so what they miss is found by prefixes of the sets, which miss no pair.
There too a signature of 256 bits spares the verification of most candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, release_memory, tidy

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Stored fingerprints and probes of one cell.
BLOCK, PROBES = 512, 4096
#: About so many documents' shingles are counted for the order of rarity, and the shingles put last in it.
ORDER_DOCS, COMMON = 20_000, 1 << 16
#: Sets, and shingles of these, of one block of documents that may be similar.
PART_ROWS, PART_SHINGLES = 512, 1 << 18
#: Bits of the filter by which only candidates' texts are cut again.
FILTER_BITS = 1 << 22
#: What a row in a shuffle costs, in comparisons of two fingerprints.
ROW_COST = 100
#: Signature words of a shingle set, and the differing bits beyond which a pair isn't verified, for sets of
#: SMALL_SET shingles at least and for smaller ones. At a similarity of 0.8 a bit differs with a
#: probability of at most 0.155 (39 of 256, deviation 5.8), or 0.19 for tiny sets (49, 6.3): a
#: similar pair is beyond with a probability below 1e-8 (1e-6 for tiny sets).
SIGNATURE, MOST_BITS, MOST_BITS_SMALL, SMALL_SET = 4, 72, 80, 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    h = xxhash.xxh64_intdigest
    if n == 1:
        return h(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((h(g, SEED) for g in grams), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for lo in range(0, n, 32768):
        bits = np.unpackbits(hashes[lo : lo + 32768].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _with(docs: DataFrame, text_col: str, names: list[str], make) -> DataFrame:
    """Replace the text by long columns, the unsigned numbers that ``make`` gives; others stay."""
    keep = [f.name for f in docs.schema.fields if f.name not in (text_col, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([make(t.as_py()) for t in b.column(len(keep))], dtype=np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in made.T], names=keep + names)
        release_memory()

    cols = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*cols, *[F.lit(0).cast("long").alias(c) for c in names]).schema
    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Replace the text by ``fp`` (the fingerprint as a signed long); other columns stay."""
    return _with(docs, text_col, ["fp"], lambda t: fingerprint(t, shingle))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of both bits set), from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["i", "j", "c"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    out, n = np.zeros((64, 64)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["c"]
        else:
            out[r["i"], r["j"]] = r["c"]
    return n, out


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about 64 / m bits; bits that correlate share a partition."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (sd[b], -b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda x: (corr[x, part].mean(), -x))
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def allocate(cost: list[list[float]], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 and the least summed cost.

    ``cost[i][u]`` is what partition i costs at threshold u - 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for u, x in enumerate(row):
                if used + u <= tau + 1 and (used + u not in new or c + x < new[used + u][0]):
                    new[used + u] = (c + x, ts + [u - 1])
        best = new
    return best[tau + 1][1]


def _value(bits: list[int]) -> Column:
    """The partition's bits of ``fp``, packed, as a column."""
    runs, start = [], 0
    for i in range(1, len(bits) + 1):
        if i == len(bits) or bits[i] != bits[i - 1] + 1:
            runs.append((start, bits[start], i - start))
            start = i
    out = F.lit(0).cast("long")
    for at, first, length in runs:
        mask = (1 << length) - 1
        piece = F.shiftrightunsigned("fp", first) if first else F.col("fp")
        out = out.bitwiseOR(F.shiftleft(piece.bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long")), at))
    return out


def plan_partitions(fps: DataFrame, tau: int, choices: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to use, by estimated cost over all fingerprints."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    equal = np.clip(p * p + (1 - p) ** 2, 1e-9, 1 - 1e-9)
    options = {m: group_bits(n, both, m) for m in choices if m <= tau + 1}
    named = [(m, i, bits) for m, parts in options.items() for i, bits in enumerate(parts)]
    cells = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _value(bits).alias("v")) for k, (_, _, bits) in enumerate(named)])).alias("c")).select("c.*")
    same = cells.groupBy("k", "v").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    pairs = {r["k"]: r["pairs"] for r in same.collect()}
    plans = []
    for m, parts in options.items():
        cost = []
        for i, bits in enumerate(parts):
            meet = pairs.get(next(k for k, x in enumerate(named) if x[0] == m and x[1] == i), 0.0) + 1
            odds = ((1 - equal) / equal)[bits]
            row, candidates, probes = [0.0], 0.0, 0
            power = [1.0]
            for t in range(tau + 1):
                if t:
                    # pairs that differ in exactly t of the bits, relative to those that agree on all
                    power.append((odds.sum() ** t) / math.factorial(t))
                probes += math.comb(len(bits), t)
                candidates += meet * power[t]
                row.append(n * (1.0 + (probes - 1) / 2) * ROW_COST + candidates)
            cost.append(row)
        ts = allocate(cost, tau)
        plans.append((sum(c[t + 1] for c, t in zip(cost, ts, strict=True)), m, ts))
    _, m, ts = min(plans)
    return [(bits, t) for bits, t in zip(options[m], ts, strict=True) if t >= 0]


def _flips(bits: int, t: int) -> list[int]:
    """All values with 1..t of the low ``bits`` bits set."""
    out, layer = [], [(0, -1)]
    for _ in range(t):
        layer = [(v | 1 << b, b) for v, last in layer for b in range(last + 1, bits)]
        out += [v for v, _ in layer]
    return out


def _probes(k: int, v: Column, flips: list[int]) -> Column:
    """The values that differ from v by one of the flips, and are larger.

    A pair that differs here would meet from either end; one end will do.
    """
    values = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda f: v.bitwiseXOR(f))
    return F.transform(F.filter(values, lambda x: x > v), lambda x: F.struct(F.lit(k).alias("k"), x.alias("v")))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node to the least node of its part."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def cell_links(cell: np.ndarray, tag: np.ndarray, node: np.ndarray, words: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside cells: rows arrive sorted by cell.

    Two rows link if their ``words`` (64-bit columns) differ in at most ``most`` bits in all.
    Tags: 0 meets 0, 1 meets 2, 3 meets 4 and nothing else. (Stored rows of one block; of two
    blocks; stored rows and probes.)
    """
    bits = [w.view(np.uint64) for w in words]
    n = len(node)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.zeros(0, int)
    length = np.diff(np.append(starts, n))
    us, vs, held = [], [], 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal us, vs, held
        us.append(node[i])
        vs.append(node[j])
        held += len(i)
        if held > 500_000:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)

    # small cells all at once: each row with the one d places on
    end = np.repeat(starts + length, length)
    at = np.flatnonzero(np.repeat(length <= 32, length))
    for d in range(1, 32):
        at = at[at + d < end[at]]
        if not len(at):
            break
        x, y = np.minimum(tag[at], tag[at + d]), np.maximum(tag[at], tag[at + d])
        i = at[((x == 0) & (y == 0)) | ((x == 1) & (y == 2)) | ((x == 3) & (y == 4))]
        i = i[sum(np.bitwise_count(w[i] ^ w[i + d]) for w in bits) <= most]
        keep(i, i + d)
    for s, k in zip(starts[length > 32], length[length > 32], strict=True):
        t = tag[s : s + k]
        for a, b in ((0, 0), (1, 2), (3, 4)):
            left, right = np.flatnonzero(t == a) + s, np.flatnonzero(t == b) + s
            if not len(left) or not len(right):
                continue
            for lo in range(0, len(left), 256):
                row = left[lo : lo + 256]
                i, j = np.nonzero(sum(np.bitwise_count(w[row][:, None] ^ w[right][None, :]).astype(np.int16) for w in bits) <= most)
                i, j = row[i], right[j]
                if a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    keep(i, j)
    if not held:
        return np.zeros(0, node.dtype), np.zeros(0, node.dtype)
    return _forest(np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, tau: int = 3, compare: tuple[str, ...] = ("fp",), most: int | None = None) -> DataFrame:
    """``u, v``: links among nodes that give the same components as all links.

    ``fps`` has ``node``, ``fp`` and the columns to ``compare``. Every two nodes whose fp
    differ in at most ``tau`` bits are compared; they link if the ``compare`` columns
    differ in at most ``most`` bits (else ``tau``).

    Stored rows of a partition value are cut into blocks of BLOCK, probes into blocks of
    PROBES, by hash; a cell is a block, a pair of blocks, or a block and a block of probes.
    """
    most = tau if most is None else most
    stored, probed = [], []
    for k, (bits, t) in enumerate(plan_partitions(fps, tau)):
        v = _value(bits)
        stored.append(F.struct(F.lit(k).alias("k"), v.alias("v")))
        if t:
            probed.append(_probes(k, v, _flips(len(bits), t)))
    own = fps.select("node", *compare, F.explode(F.array(*stored)).alias("c")).select("node", *compare, "c.k", "c.v")
    size = own.groupBy("k", "v").agg(F.count("*").alias("n"))
    h = F.xxhash64("node")
    spread = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    cells = []
    if probed:
        visit = fps.select("node", *compare, F.explode(F.concat(*probed)).alias("c")).select("node", *compare, "c.k", "c.v")
        visits = visit.groupBy("k", "v").agg(F.count("*").alias("p"))
        size = size.join(visits.withColumnsRenamed({"k": "p_k", "v": "p_v"}), (F.col("k") == F.col("p_k")) & (F.col("v") == F.col("p_v")), "left").select("k", "v", "n", F.coalesce("p", F.lit(0)).alias("p"))
    else:
        size = size.withColumn("p", F.lit(0).cast("long"))
    size = materialize(size.where("n > 1 or p > 0").select(F.col("k").alias("s_k"), F.col("v").alias("s_v"), F.ceil(F.col("n") / BLOCK).alias("nb"), F.ceil(F.col("p") / PROBES).alias("pb"), "n"), "simhash-sizes")
    here = (F.col("k") == F.col("s_k")) & (F.col("v") == F.col("s_v"))
    mine = own.join(size, here).withColumn("a", F.pmod(h, F.col("nb")))
    pairs = mine.where("n > 1").withColumn("b", spread(F.col("nb") - 1))
    tag = F.when(F.col("a") == F.col("b"), 0).when(F.col("a") < F.col("b"), 1).otherwise(2)
    cells.append(pairs.select(F.xxhash64(F.lit(0), "k", "v", F.least("a", "b"), F.greatest("a", "b")).alias("cell"), tag.alias("tag"), "node", *compare))
    if probed:
        kept = mine.where("pb > 0").withColumn("b", spread(F.col("pb") - 1))
        cells.append(kept.select(F.xxhash64(F.lit(1), "k", "v", "a", "b").alias("cell"), F.lit(3).alias("tag"), "node", *compare))
        met = visit.join(size, here).withColumn("b", F.pmod(h, F.col("pb"))).withColumn("a", spread(F.col("nb") - 1))
        cells.append(met.select(F.xxhash64(F.lit(1), "k", "v", "a", "b").alias("cell"), F.lit(4).alias("tag"), "node", *compare))
    rows = cells[0]
    for c in cells[1:]:
        rows = rows.unionByName(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(x: list[np.ndarray]) -> pa.RecordBatch:
            u, v = cell_links(x[0], x[1], x[2], x[3:], most)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield found([x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield found(rest)
        release_memory()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the least node reachable, for every node of ``u, v`` edges.

    Large-star then small-star until nothing changes; each star is a grouped minimum
    and a join, so the neighbours of a node are never gathered.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the least of the neighbourhood
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        # small star: smaller neighbours, and the node itself, hang on the least of them
        small = large.join(least, F.col("u") == F.col("n"))
        older, e = e, materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        release(older, large)
        tidy(edges.sparkSession)
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id, key, fp, component_id``, one row a document.

    ``component_id`` is the least id reachable over links of at most ``tau`` differing
    bits. ``key`` hashes id and text, for joining back.

    Defined cases: null, empty and wordless texts have fingerprint 0, linked like any
    other; repeated rows share a component; null ids belong to their component but
    never name it, unless it has no other (then null); extra columns are ignored; an
    empty table gives none.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    d = materialize(with_fingerprint(d, "text", shingle), "simhash").withColumn("node", F.col("fp"))
    return _components_of(d, links(_distinct(d, ["fp"]), tau)).select("doc_id", "key", "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending; a short text is one shingle, a wordless one the empty shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    h, n = xxhash.xxh64_intdigest, max(len(words) - shingle + 1, 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 else [b" ".join(words)]
    return np.unique(np.fromiter((h(g, SEED) for g in grams), dtype=np.uint64, count=n) >> np.uint64(2)).view(np.int64)


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def signature(x: np.ndarray) -> list[int]:
    """SIGNATURE words of 64 majority bits each, of the set's hashes mixed in as many ways."""
    x, out = x.view(np.uint64), []
    for odd in _MIX[:SIGNATURE]:
        y = x * np.uint64(odd)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(_MIX[0])
        out.append(majority(y ^ (y >> np.uint64(32))))
    return out


def common_shingles(d: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample, ascending: at most COMMON.

    They only steer the cost: prefixes find all pairs under any order of the shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_arrays([shingle_hashes(t.as_py(), shingle) for t in b.column(0)])], names=["x"])
        release_memory()

    n = d.count()
    sample = d if n <= ORDER_DOCS else d.where(F.col("key") < F.lit(-(2**63) + int(2**64 * ORDER_DOCS / n)))
    counts = sample.select("text").mapInArrow(run, "x array<long>").select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    top = counts.where("n > 2").orderBy(F.desc("n"), "x").limit(COMMON)
    return np.sort(np.array([r["x"] for r in top.select("x").collect()], dtype=np.int64))


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with a set of that Jaccard similarity."""
    return max(math.ceil(similarity * n - 1e-9), 1)


SIGNED = [f"s{i}" for i in range(SIGNATURE)]


def _prefixes(d: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """Replace ``text`` by ``node`` (the hash of its shingle set), ``n``, the signature and ``prefix``.

    The prefix holds so many of the shingles, common ones last, that sets of the given
    similarity cannot both miss the other's: n - least_overlap(n) + 1 (a pigeonhole).
    """
    names = ["doc_id", "key", "node", "n", *SIGNED, "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, signed, prefix = [], [], [], []
            for t in b.column(2):
                x = shingle_hashes(t.as_py(), shingle)
                m = len(x) - least_overlap(len(x), similarity) + 1
                node.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                n.append(len(x))
                signed.append(signature(x))
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x
                    x = np.concatenate([x[~last][:m], x[last][: max(m - int((~last).sum()), 0)]])
                prefix.append(x[:m])
            words = np.array(signed, dtype=np.uint64).reshape(-1, SIGNATURE).T
            made = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(w).view(np.int64)) for w in words], _arrays(prefix)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=names)
        release_memory()

    zero = F.lit(0).cast("long")
    schema = d.select("doc_id", "key", *[zero.alias(c) for c in ("node", "n", *SIGNED)], F.array(zero).alias("prefix")).schema
    return d.select("doc_id", "key", "text").mapInArrow(run, schema)


def _by_cell(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` gets the columns of whole cells, sorted by ``cell`` and ``node``, and yields columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest is not None else now
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                for out in make(*(x[:cut] for x in now)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)
        if rest is not None and len(rest[0]):
            for out in make(*rest):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)
        release_memory()

    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, schema)


def _bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return starts, np.diff(np.append(starts, len(cell)))


def met(cell: np.ndarray, node: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The rows of cells with more than one node."""
    starts, length = _bounds(cell)
    keep = np.repeat(length > 1, length)
    yield [cell[keep], node[keep]]


def candidate_pairs(cell: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, *signed: np.ndarray, similarity: float, star: bool) -> Iterator[list[np.ndarray]]:
    """``u, v`` of a cell that have different roots, and sizes and signatures that allow the similarity.

    With ``star`` only the cell's first node meets the others. Else all do: of each part
    of a cell (equal roots) but the largest, the rows meet those of larger parts only.
    """

    words = [w.view(np.uint64) for w in signed]

    def fit(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        ok = np.flatnonzero((root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9))
        if words:
            far = sum(np.bitwise_count(w[i[ok]] ^ w[j[ok]]).astype(np.int16) for w in words)
            ok = ok[far <= np.where(np.minimum(n[i[ok]], n[j[ok]]) < SMALL_SET, MOST_BITS_SMALL, MOST_BITS)]
        u, v = np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)]
        return [u[new], v[new]]

    starts, length = _bounds(cell)
    if star:
        yield fit(np.repeat(starts, length), np.arange(len(cell)))
        return
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    small = np.repeat(mixed & (length <= 32), length)
    end, at = np.repeat(starts + length, length), np.flatnonzero(small)
    for k in range(1, 32):
        at = at[at + k < end[at]]
        if not len(at):
            break
        yield fit(at, at + k)
    for s, k in zip(starts[mixed & (length > 32)], length[mixed & (length > 32)], strict=True):
        _, part, size = np.unique(root[s : s + k], return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(size, kind="stable"))[part]
        order = np.argsort(rank, kind="stable") + s
        after = np.searchsorted(rank[order - s], rank[order - s], side="right")
        i, held = [], 0
        for x in range(int(np.searchsorted(after, k))):
            i.append(x)
            held += k - after[x]
            if held > 1_000_000:
                yield fit(order[np.repeat(i, k - after[i])], order[np.concatenate([np.arange(after[y], k) for y in i])])
                i, held = [], 0
        if i:
            yield fit(order[np.repeat(i, k - after[i])], order[np.concatenate([np.arange(after[y], k) for y in i])])


def candidate_forest(*columns: np.ndarray, similarity: float) -> Iterator[list[np.ndarray]]:
    """A spanning forest of the candidate pairs, those of all rows of the cells: as many rows as nodes at most."""
    us, vs, held = [], [], 0
    for u, v in candidate_pairs(*columns, similarity=similarity, star=False):
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > 500_000:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
    if held:
        yield list(_forest(np.concatenate(us), np.concatenate(vs)))


def similar_sets(cell: np.ndarray, node: np.ndarray, tag: np.ndarray, root: np.ndarray, x: np.ndarray, *signed: np.ndarray, similarity: float) -> Iterator[list[np.ndarray]]:
    """A spanning forest of the pairs of different roots whose sets ``x`` have the similarity.

    Rows of tag 0 meet each other, those of tag 1 meet those of tag 2.
    """
    words = [w.view(np.uint64) for w in signed]
    size = np.fromiter(map(len, x), dtype=np.int64, count=len(x))
    us, vs = [], []
    for s, k in zip(*_bounds(cell), strict=True):
        if k < 2:
            continue
        first = np.concatenate([[0], np.cumsum(size[s : s + k])])
        number = np.unique(np.concatenate(x[s : s + k]), return_inverse=True)[1]
        here = np.zeros(int(number.max()) + 1, dtype=bool)
        for a, b in ((0, 0), (1, 2)):
            right = np.flatnonzero(tag[s : s + k] == b) + s
            for i in np.flatnonzero(tag[s : s + k] == a) + s:
                j = right[right > i] if a == b else right
                j = j[root[j] != root[i]]
                small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
                ok = small >= similarity * large - 1e-9
                if words:
                    far = sum(np.bitwise_count(w[j] ^ w[i]).astype(np.int16) for w in words)
                    ok &= far <= np.where(small < SMALL_SET, MOST_BITS_SMALL, MOST_BITS)
                j = j[ok]
                if not len(j):
                    continue
                own = number[first[i - s] : first[i - s + 1]]
                here[own] = True
                ends = np.cumsum(size[j])
                at = np.arange(ends[-1]) + np.repeat(first[j - s] - (ends - size[j]), size[j])
                both = np.add.reduceat(here[number[at]], ends - size[j], dtype=np.int64)
                here[own] = False
                j = j[both / (size[j] + size[i] - both) >= similarity]
                us.append(np.full(len(j), node[i]))
                vs.append(node[j])
    if sum(map(len, us)):
        yield list(_forest(np.concatenate(us), np.concatenate(vs)))


def _sets_of(d: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """``node, x``: all shingles of the needed nodes (``node, key``, the key of one of its documents)."""
    slot = F.pmod("key", F.lit(FILTER_BITS))
    words = needed.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    bits[[r["w"] for r in words]] = [r["m"] for r in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() % FILTER_BITS
            keep = np.flatnonzero(bits[at >> 5] >> (at & 31) & 1)
            if len(keep):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), _arrays([shingle_hashes(b.column(1)[int(i)].as_py(), shingle) for i in keep])], names=["key", "x"])
        release_memory()

    found = d.select("key", "text").mapInArrow(run, "key long, x array<long>")
    one = found.join(needed.select(F.col("key").alias("n_key"), "node"), F.col("key") == F.col("n_key")).select("node", "x")
    return materialize(one.dropDuplicates(["node"]), "shingle-sets")


def _verified(pairs: DataFrame, d: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity; ``pairs`` are released."""
    ids = pairs.select(F.col("u").alias("i")).union(pairs.select("v")).distinct()
    needed = materialize(nodes.join(ids, F.col("node") == F.col("i")).select("node", "key"), "shingle-needed")
    sets = _sets_of(d, needed, shingle)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("x").alias("b")), "v")
    both = both.select("u", "v", F.size("a").alias("p"), F.size("b").alias("q"), F.size(F.array_intersect("a", "b")).alias("c"))
    out = materialize(both.where(F.col("c") / (F.col("p") + F.col("q") - F.col("c")) >= F.lit(similarity)).select("u", "v"), "shingle-links")
    release(pairs, needed, sets)
    return out


def _verified_in_parts(forest: DataFrame, d: DataFrame, sized: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links of the similarity between nodes of different roots, for all candidate pairs that ``forest`` spans.

    Both nodes of a candidate pair are in one component of the forest, a part. A part is cut into blocks by
    hash, of PART_ROWS sets and PART_SHINGLES shingles on average at most; a cell is a block or two blocks,
    and compares its sets itself, so that no candidate pair becomes a row.
    """
    found = components(forest)
    parts = materialize(found.union(found.select("root", "root")).distinct().select(F.col("node").alias("p_node"), F.col("root").alias("part")), "shingle-parts")
    members = materialize(sized.join(parts, F.col("s_node") == F.col("p_node")).select(F.col("s_node").alias("m_node"), "key", "part", "n", "root", *SIGNED), "shingle-members")
    sets = _sets_of(d, members.select(F.col("m_node").alias("node"), "key"), shingle)
    blocks = F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES))
    size = members.groupBy("part").agg(blocks.alias("nb")).withColumnRenamed("part", "s_part")
    dealt = members.join(size, F.col("part") == F.col("s_part")).withColumn("a", F.pmod(F.xxhash64("m_node"), F.col("nb")))
    dealt = dealt.join(sets, F.col("m_node") == F.col("node"))
    dealt = dealt.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    tag = F.when(F.col("a") == F.col("b"), 0).when(F.col("a") < F.col("b"), 1).otherwise(2)
    rows = dealt.select(F.xxhash64("part", F.least("a", "b"), F.greatest("a", "b")).alias("cell"), "node", tag.alias("tag"), "root", "x", *SIGNED)
    out = materialize(_by_cell(rows, lambda *c: similar_sets(*c, similarity=similarity), "u long, v long"), "shingle-links")
    release(forest, parts, members, sets)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tau: int = 3) -> DataFrame:
    """``doc_id, key, root, component_id``: components over all pairs of at least that similarity.

    The similarity is the Jaccard similarity of the sets of word shingles, exact up to
    collisions of 62-bit hashes; every link is verified on whole sets. Candidates come from
    three rounds, each among nodes that are not in one component yet: fingerprints within
    ``tau`` bits (the generalised pigeonhole); then, of documents that share a shingle of their
    prefixes, each cell's least node with the others, then all of them, which meet in blocks. ``root`` names a component
    even where all its ids are null. Cases as in ``near_duplicates``.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    made = materialize(_prefixes(text, shingle, similarity, common_shingles(text, shingle)), "shingle-prefixes")
    own = made.select("node", F.struct("key", "n", *SIGNED).alias("s"))
    nodes = materialize(own.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.*"), "shingle-nodes")
    rows = made.join(nodes.select(F.col("node").alias("o_node"), F.col("key").alias("o_key")), (F.col("node") == F.col("o_node")) & (F.col("key") == F.col("o_key")), "left_semi")
    rows = rows.dropDuplicates(["node"]).select(F.explode("prefix").alias("cell"), "node")
    cells = materialize(_by_cell(rows, met, "cell long, node long"), "shingle-cells")
    d = materialize(made.select("doc_id", "key", "node"), "shingle-documents")
    release(made)
    tidy(spark)
    proposed = materialize(links(nodes.select("node", F.col(SIGNED[0]).alias("fp")), tau), "shingle-pairs")
    found = [_verified(proposed, text, nodes, shingle, similarity)]
    for star in (True, False):
        tidy(spark)
        roots = materialize(components(_union(found)).select(F.col("node").alias("r_node"), "root"), "shingle-roots")
        sized = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select(F.col("node").alias("s_node"), "key", "n", F.coalesce("root", "node").alias("root"), *SIGNED)
        named = cells.join(sized.drop("key"), F.col("node") == F.col("s_node")).select("cell", "node", "n", "root", *SIGNED)
        if star:
            pairs = _by_cell(named, lambda *x: candidate_pairs(*x, similarity=similarity, star=True), "u long, v long")
            found.append(_verified(materialize(pairs.distinct(), "shingle-pairs"), text, nodes, shingle, similarity))
        else:
            forest = _by_cell(named, lambda *x: candidate_forest(*x, similarity=similarity), "u long, v long")
            found.append(_verified_in_parts(materialize(forest.distinct(), "shingle-forest"), text, sized, shingle, similarity))
        release(roots)
    release(cells, nodes)
    return _components_of(d, _union(found)).select("doc_id", "key", "root", "component_id")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _distinct(d: DataFrame, cols: list[str]) -> DataFrame:
    return materialize(d.groupBy("node").agg(*[F.first(c).alias(c) for c in cols]), "simhash-nodes")


def _components_of(d: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``root`` and ``component_id``, the least doc_id, of each node's component."""
    roots = materialize(components(found).select(F.col("node").alias("r_node"), "root"), "simhash-roots")
    firsts = d.groupBy("node").agg(F.min("doc_id").alias("first"))
    r = firsts.join(roots, F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    r = materialize(r, "simhash-members")
    least = r.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "l_root")
    named = r.join(least, F.col("root") == F.col("l_root")).select(F.col("node").alias("n_node"), "root", "component_id")
    return d.join(named, F.col("node") == F.col("n_node"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
