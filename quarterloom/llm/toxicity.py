"""Toxicity scores from Levenshtein automata over a lexicon trie.

Method: a lexicon of words and word beginnings is learned from labelled documents (those
that mark toxic ones, by the likelihood-ratio statistic of their document counts). Its
trie is intersected with Levenshtein automata: one lazily determinised automaton whose
states are sets of (trie node, edits, letter due after a swap), so a misspelled term is found in one pass over
the word's letters. Each hit is weighed by its context window: inside quotation marks or
next to words of reporting it counts less than as an address. A logistic regression on
the weighed hits gives the score.

The lexicon and the regression are fitted on a bounded sample of labelled rows, at most
SAMPLE_TOXIC and SAMPLE_CLEAN documents by hash of their id; scoring reads every
whole text, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, release_memory

#: Bounds of the labelled sample that the model is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 7000
#: What a term of the lexicon has: letters, documents, evidence, and odds against clean documents.
MIN_LETTERS, MAX_LETTERS = 3, 12
MIN_TOXIC, MIN_EVIDENCE, MIN_ODDS = 3, 20.0, 2.5
#: A term occurs in at most this many clean documents for each toxic one.
MAX_CLEAN = 0.35
#: Words on either side of a hit that are its context.
CONTEXT = 6
QUOTED, REPORTED = 0.3, 0.6
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
REPORTING = frozenset("said says wrote writes called quoted quote word term insult dit écrit dijo escribió sagte schrieb".split())
LEET = str.maketrans("013457@$!", "oieastasi")
CACHE = 250_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    whole: bool  # a word; else the beginning of words
    edits: int  # misspellings allowed


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    bias: float = -3.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    mean: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    sd: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)


class Automaton:
    """All terms' Levenshtein automata, intersected with their trie, determinised on demand."""

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits that any term below a node allows
        for t, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for ch in term.text:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][ch]
                self.most[node] = max(self.most[node], term.edits)
            self.ends[node].append(t)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.word: list[tuple[int, int] | None] = []  # (edits, term) if the word ends here
        self.start: list[tuple[int, int] | None] = []  # (edits, term) whatever follows
        self.first = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        best: dict[tuple[int, str], int] = {}
        todo = sorted(items, key=lambda p: p[1])
        while todo:
            node, e, due = todo.pop(0)
            if e > self.most[node] or best.get((node, due), 99) <= e:
                continue
            best[node, due] = e
            if not due:
                todo += [(c, e + 1, "") for c in self.child[node].values()]  # a letter of the term left out
        key = frozenset((node, e, due) for (node, due), e in best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            done = [(e, t) for node, e, due in key if not due for t in self.ends[node] if e <= self.terms[t].edits]
            self.word.append(min(done, default=None))
            self.start.append(min((x for x in done if not self.terms[x[1]].whole), default=None))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, e, due in self.sets[state]:
            if due:
                if due == ch:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))  # a letter too many
            for c, child in self.child[node].items():
                out.add((child, e + (c != ch), ""))
                if c != ch and ch in self.child[child]:
                    out.add((self.child[child][ch], e + 1, c))  # two letters in the wrong order
        nxt = self.moves[state][ch] = self._state(out)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        if len(self.sets) > 100_000:
            self._reset()
        state, best = self.first, self.start[self.first]
        for ch in word[:64]:
            nxt = self.moves[state].get(ch)
            state = self._move(state, ch) if nxt is None else nxt
            if not self.sets[state]:
                return best
            s = self.start[state]
            if s is not None and (best is None or s < best):
                best = s
        # the rest of an overlong word can only be surplus letters
        w = self.word[state] if len(word) <= 64 else None
        return min((x for x in (w, best) if x is not None), default=None)


def normal(piece: str) -> list[str]:
    """Forms of a piece of text to look up: as it is, its parts, letters for look-alikes."""
    p = _EDGE.sub("", piece.lower())
    out = [p] if p else []
    if p and not p.isalpha():
        parts = [x for x in _INNER.split(p) if len(x) >= MIN_LETTERS]
        plain = _EDGE.sub("", piece.lower().rstrip(".,;:!?").translate(LEET))
        out += parts + [_INNER.sub("", plain)]
    return list(dict.fromkeys(x for x in out if len(x) >= MIN_LETTERS - 1))


class Scorer:
    """Hits and features of texts; remembers pieces it has seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.auto = model, Automaton(model.terms)
        self.seen: set[str] = set()
        self.bad: dict[str, tuple[int, int]] = {}

    def hits(self, pieces: list[str]) -> dict[str, tuple[int, int]]:
        own = set(pieces)
        new = own - self.seen
        if new:
            if len(self.seen) > CACHE:
                self.seen, self.bad = set(), {}
                new = own
            for p in new:
                m = min((x for x in map(self.auto.match, normal(p)) if x), default=None)
                if m:
                    self.bad[p] = m
            self.seen |= new
        return {p: self.bad[p] for p in own.intersection(self.bad)} if self.bad else {}

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log of weighed exact hits, of misspelled ones, the strongest hit, hits a word."""
        pieces = (text or "").split()
        found = self.hits(pieces)
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        exact = fuzzy = most = 0.0
        for i, p in enumerate(pieces):
            if p in found:
                edits, t = found[p]
                w = self.model.terms[t].weight * context(pieces, i)
                most = max(most, w * 0.85**edits)
                exact, fuzzy = (exact + w, fuzzy) if edits == 0 else (exact, fuzzy + w)
        return math.log1p(exact), math.log1p(fuzzy), most, math.log1p(100 * (exact + fuzzy) / len(pieces))

    def score(self, text: str | None) -> float:
        m = self.model
        z = m.bias + sum(w * (x - a) / s for w, x, a, s in zip(m.weights, self.features(text), m.mean, m.sd, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def context(pieces: list[str], i: int) -> float:
    """1 for an address, less for quotation or report, from the words around."""
    lo, hi = max(0, i - CONTEXT), min(len(pieces), i + CONTEXT + 1)
    opened = next((j for j in range(i, lo - 1, -1) if pieces[j][0] in OPENING), None)
    if opened is not None and not any(len(pieces[j]) > 1 and pieces[j].rstrip(".,;:!?")[-1:] in CLOSING for j in range(opened, i)) and any(pieces[j].rstrip(".,;:!?")[-1:] in CLOSING for j in range(i, hi)):
        return QUOTED
    return REPORTED if any(_EDGE.sub("", p.lower()) in REPORTING for p in pieces[lo:hi]) else 1.0


# ---- fitting -------------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows, by hash.

    Only ids whose crc32 modulo 5 isn't 0. Exact copies count once, near copies mostly do. An id labelled more than once is toxic if
    any of its labels is.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    y = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(6)))
    some = least_hashed(y.where("toxic = 1"), "h", SAMPLE_TOXIC, ("doc_id",)).union(least_hashed(y.where("toxic = 0"), "h", SAMPLE_CLEAN, ("doc_id",)))
    some = some.select(F.col("doc_id").alias("y_id"), "toxic", "h")
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of three numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("y_id")).select("text", "toxic", "h")
    rows = rows.mapInArrow(_sketches, "text string, toxic int, h long, m1 long, m2 long")
    # copies would make chance words look like terms: of rows with an equal sketch one stays
    for m in ("m1", "m2"):
        rows = rows.groupBy(m).agg(F.min_by(F.struct("text", "toxic", "h", "m2"), F.struct("h", "toxic")).alias("r")).select("r.*")
    return rows.select("text", "toxic")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least hashes of a text's five-word shingles under two orders."""
    for b in batches:
        m = []
        for text in b.column(0).to_pylist():
            w = (text or "").split()
            x = np.fromiter((zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))), dtype=np.int64)
            m.append((int(x.min()), int((x * 2654435761 % 4294967291).min())))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in m], pa.int64()), pa.array([c for _, c in m], pa.int64())], names=["text", "toxic", "h", "m1", "m2"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, bool], list[int]] = {}
    n = [0, 0]
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[y] += 1
            words = {w for p in set((text or "").split()) for w in normal(p)[:1]}
            for key in {(w, True) for w in words if len(w) <= MAX_LETTERS} | {(w[:k], False) for w in words for k in range(MIN_LETTERS, min(len(w), MAX_LETTERS) + 1)}:
                counts.setdefault(key, [0, 0])[y] += 1
    counts[("", True)] = n
    keys = list(counts)
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part]), pa.array([counts[k][0] for k in part], pa.int64()), pa.array([counts[k][1] for k in part], pa.int64())], names=["term", "whole", "clean", "toxic"])


def _odds(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    return F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))


def _evidence(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """The likelihood-ratio statistic for a term that marks toxic documents; 0 if it doesn't."""
    g = F.lit(0.0)
    for a, b in ((toxic, clean), (n1 - toxic, n0 - clean)):
        for x, col in ((a, n1), (b, n0)):
            g = g + F.when(x > 0, 2 * x * F.log(x * float(n0 + n1) / ((a + b) * col))).otherwise(0.0)
    return F.when(toxic * n0 > clean * n1, g).otherwise(0.0)


def choose_terms(counts: list[tuple[str, bool, int, int]], n0: int, n1: int) -> list[Term]:
    """The lexicon from all (term, whole word?, clean documents, toxic documents) with enough evidence."""
    odds = lambda t, c: math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
    good = {(w, whole): (t, c) for w, whole, c, t in counts}
    begin = {w: tc for (w, whole), tc in good.items() if not whole}
    longer, purer = Counter(), set()
    for w, (t, c) in begin.items():
        longer[w[:-1]] = max(longer[w[:-1]], t)
        t_up, c_up = begin.get(w[:-1], (0, 0))
        if t >= 0.6 * t_up and c <= 0.5 * c_up:
            purer.add(w[:-1])
    terms: list[Term] = []
    kept: list[str] = []
    for w, (t, c) in sorted(begin.items(), key=lambda x: (len(x[0]), x[0])):
        # the longest beginning that still covers its documents, or a purer one; none below a kept one
        if longer[w] >= 0.95 * t or w in purer or any(w.startswith(k) for k in kept):
            continue
        word = good.get((w, True))
        whole = bool(word and word[0] >= 0.7 * t)
        edits = 0 if len(w) < (5 if whole else 7) else 2 if whole and len(w) >= 9 else 1
        terms.append(Term(w, odds(t, c), whole, edits))
        if not whole:
            kept.append(w)
    return sorted(terms, key=lambda t: -t.weight)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1e-6] + [l2] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1.T * (p * (1 - p) + 1e-9)) @ x1 + ridge, x1.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon and the regression, from the bounded labelled sample.

    Without both classes the lexicon is empty and every score is the bias's.
    """
    sample, counts = training_sample(docs, labels).persist(), None
    try:
        counts = sample.mapInArrow(_count_terms, "term string, whole boolean, clean long, toxic long").groupBy("term", "whole").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        counts = counts.persist()
        size = counts.where("term = ''").agg(F.sum("clean"), F.sum("toxic")).first()
        n0, n1 = size[0] or 0, size[1] or 0
        if not n0 or not n1:
            return Model()
        # all terms with enough evidence: no more than the bounded sample has
        toxic, clean = F.col("toxic"), F.col("clean")
        good = counts.where((F.col("term") != "") & (toxic >= MIN_TOXIC) & (clean <= MAX_CLEAN * toxic) & (_odds(toxic, clean, n1, n0) > MIN_ODDS) & (_evidence(toxic, clean, n1, n0) >= MIN_EVIDENCE))
        terms = choose_terms([tuple(r) for r in good.select("term", "whole", "clean", "toxic").orderBy("term", "whole").collect()], n0, n1)
        model = Model(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Scorer(model)
            for b in batches:
                f, fuzzy = [], []
                for text in b.column(0).to_pylist():
                    f.append(s.features(text))
                    fuzzy.append(sorted({t for e, t in s.hits((text or "").split()).values() if e}))
                cols = [pa.array([x[i] for x in f], pa.float64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(1), *cols, pa.array(fuzzy, pa.list_(pa.int64()))], names=["toxic", "f0", "f1", "f2", "f3", "fuzzy"])

        schema = "toxic int, f0 double, f1 double, f2 double, f3 double, fuzzy array<bigint>"
        near = Counter(), Counter()
        for r in sample.mapInArrow(run, schema).select("toxic", "fuzzy").collect():
            near[r["toxic"]].update(r["fuzzy"])
        # a term whose misspellings occur in clean documents is only looked for as it is
        model.terms = [Term(t.text, t.weight, t.whole, 0 if near[0][i] > 0.02 * near[1][i] else t.edits) for i, t in enumerate(terms)]
        rows = sample.mapInArrow(run, schema).drop("fuzzy").collect()
    finally:
        sample.unpersist()
        if counts is not None:
            counts.unpersist()
    x, y = np.array([list(r)[1:] for r in rows], dtype=float).reshape(-1, 4), np.array([r["toxic"] for r in rows], dtype=float)
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    sd[x.std(axis=0) == 0] = 1.0
    bias, w = _logistic((x - mean) / sd, y)
    # a misspelled hit that the sample doesn't show counts like the strongest exact ones do
    if x[:, 1].max(initial=0) == 0:
        w[1], sd[1] = max(w[0], 0.0), sd[0]
    return Model(model.terms, bias, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, sd)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score``, the probability of label 1, to every row; one of that name is replaced."""
    keep = [f.name for f in docs.schema.fields if f.name != "score"]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            score = [s.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*keep, "score"])
        del s
        release_memory()

    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).cast("double").alias("score")).schema
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """All rows of ``docs`` with ``score`` and ``predicted`` (1 if score >= 0.5).

    The model is fitted on ``train_docs`` (else ``docs``) joined with ``labels``. Labels, language,
    source and id are no inputs of a score.

    Defined cases: null, empty and wordless texts have no hits and get the score of none;
    long texts are read whole; repeated rows get equal scores; rows without label take no
    part in fitting; without labels of both classes all scores are the prior; an empty
    table gives none.
    """
    model = fit(train_docs if train_docs is not None else docs, labels)
    return with_score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
