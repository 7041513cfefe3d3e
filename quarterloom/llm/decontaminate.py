"""Benchmark decontamination with a distributed positional inverted index.

Method: the training texts are tokenised once into a stored table, and term frequencies over
all documents order each test window's terms by rarity. The index holds the postings (term,
document, position) of every window's RAREST rarest terms. A window's lists are intersected
from the rarest on: a posting of the first term gives a start, and the start stays if the
next term's list has the document at the start plus that term's offset. What passes all lists is compared with
the text once, so results are exact: phrases by default, or, with ``slop``, unordered
proximity matches around the rarest term's postings.

Only DataFrame operations. Side tables follow the size of the test items; they are broadcast
only after their bytes are summed and are below MAX_BROADCAST, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release, tidy, words_of

#: Anything but digits, lower-case letters and characters beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Terms of a window whose posting lists are intersected.
RAREST = 2
#: Bytes of a table that may be broadcast.
MAX_BROADCAST = 32 << 20


def item_words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """``item_id, win`` (array): each ``width`` consecutive words, or all of a shorter item."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return w.withColumn("i", F.explode(starts)).select("item_id", F.slice("words", F.col("i"), width).alias("win"))


def _small(df: DataFrame, text: Column) -> DataFrame:
    """``df``, broadcast if its rows with their ``text`` are proven to be few bytes."""
    return _few(df, F.octet_length(text) + 64)


def _few(df: DataFrame, size: Column) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST else df


def _terms(wins: DataFrame, tokens: DataFrame) -> DataFrame:
    """``win_id, off, term, rank``: the terms of windows that can occur, by rarity from 1.

    Rarity is the number of occurrences in all documents. A term that no document has
    settles its windows: they occur nowhere.
    """
    vocabulary = materialize(wins.select(F.explode("win").alias("term")).distinct(), "decon-terms")
    spread = tokens.select(F.explode("words").alias("term"))
    counted = materialize(spread.join(_small(vocabulary, F.col("term")), "term").groupBy("term").agg(F.count("*").alias("df")), "decon-counts")
    at = wins.select("win_id", F.posexplode("win").alias("off", "term")).join(_small(counted, F.col("term")), "term", "left")
    by_rarity = Window.partitionBy("win_id").orderBy("df", "term", "off")
    ranked = at.withColumns({"rank": F.row_number().over(by_rarity), "dead": F.max(F.col("df").isNull()).over(Window.partitionBy("win_id"))})
    return materialize(ranked.where("not dead").select("win_id", "off", "term", "rank"), "decon-ranked")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return (a["key"] == b["p_key"]) & a["doc_id"].eqNullSafe(b["p_doc_id"])


def posting_lists(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, key, pos`` of the given terms: the index. Rows repeated in full repeat their postings."""
    spread = tokens.select("doc_id", "key", F.posexplode("words").alias("pos", "term"))
    return spread.join(_small(terms, F.col("term")), "term").select("term", "doc_id", "key", "pos")


def intersect(index: DataFrame, ranked: DataFrame, lists: int = RAREST) -> DataFrame:
    """``win_id, doc_id, key, start`` that the rarest ``lists`` terms of a window agree on.

    A window of fewer terms is looked up by those it has.
    """
    seeds = ranked.where(F.col("rank") <= lists).groupBy("win_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "off"))).alias("r"))
    r = lambda k: F.coalesce(F.get("r", F.lit(k)), F.get("r", F.lit(0)))
    seeds = materialize(seeds.select("win_id", *[c for k in range(lists) for c in (r(k)["term"].alias(f"term_{k}"), r(k)["off"].alias(f"off_{k}"))]), "decon-seeds")
    first = index.join(_small(seeds, F.concat_ws("", *[f"term_{k}" for k in range(lists)])), F.col("term") == F.col("term_0"))
    found = first.withColumn("start", F.col("pos") - F.col("off_0")).where("start >= 0").drop("term", "pos")
    for k in range(1, lists):
        other = index.select(F.col("term").alias("p_term"), F.col("doc_id").alias("p_doc_id"), F.col("key").alias("p_key"), F.col("pos").alias("p_pos"))
        found = found.join(other, _same_doc(found, other) & (found[f"term_{k}"] == other["p_term"]) & (found["start"] + found[f"off_{k}"] == other["p_pos"]), "left_semi")
    return found.select("win_id", "doc_id", "key", "start")


def _with_words(tokens: DataFrame, places: DataFrame, before: int, after: int) -> DataFrame:
    """``places`` (``win_id, doc_id, key, start``) with ``part``, the words from ``start - before`` to ``start + after``.

    Each document's places are gathered first. If those are few, the words stay where they
    are; else each document's words cross the network once.
    """
    gathered = places.groupBy(F.col("doc_id").alias("p_doc_id"), F.col("key").alias("p_key")).agg(F.collect_set(F.struct("win_id", "start")).alias("c"))
    gathered = materialize(gathered, "decon-gathered")
    own = tokens.join(_few(gathered, 48 * F.size("c") + 64), _same_doc(tokens, gathered)).select("doc_id", "key", "words", F.explode("c").alias("c"))
    lead = F.least(F.col("c.start"), F.lit(before))
    part = F.slice("words", F.col("c.start") - lead + 1, lead + after)
    return own.select("doc_id", "key", F.col("c.win_id").alias("win_id"), F.col("c.start").alias("start"), lead.alias("lead"), part.alias("part"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokenised documents ``doc_id, key, words``; matches ``doc_id, key, start, len, items``).

    ``start`` is a 0-based word position. With ``slop``, a match is a span of at most
    ``width + slop`` words from the rarest term on either side that holds all of the
    window's terms in any order (``start`` and ``len`` give that span).
    """
    tokens = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), item_words(F.col("text")).alias("words"))
    tokens = materialize(tokens, "decon-words")
    wins = windows_of(items, width).groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    wins = materialize(wins.withColumn("win_id", F.xxhash64("win")), "decon-windows")
    ranked = _terms(wins, tokens)
    lists = RAREST if slop is None else 1
    index = materialize(posting_lists(tokens, ranked.where(F.col("rank") <= lists).select("term").distinct()), "decon-index")
    size = F.size("win")
    known = _small(wins, F.concat_ws("", F.flatten(F.array("win", "items"))))
    if slop is None:
        places = materialize(intersect(index, ranked, lists), "decon-places")
        release(index)
        tidy(docs.sparkSession)
        met = _with_words(tokens, places, 0, width).join(known, "win_id")
        return tokens, met.where(F.slice("part", 1, size) == F.col("win")).select("doc_id", "key", "start", size.alias("len"), "items")
    seeds = ranked.where("rank = 1").select(F.col("term").alias("s_term"), "win_id")
    places = index.join(seeds, F.col("term") == F.col("s_term")).select("win_id", "doc_id", "key", F.col("pos").alias("start"))
    found = _with_words(tokens, places, width - 1 + slop, width + slop).join(known, "win_id")
    spans = F.transform(F.sequence(F.lit(0), size + slop - 1), lambda b: F.slice("part", F.greatest(F.col("lead") - b + 1, F.lit(1)), F.least(size + slop, F.col("lead") + size + slop - b)))
    need = lambda s: F.forall(F.array_distinct("win"), lambda t: F.size(F.filter(s, lambda x: x == t)) >= F.size(F.filter("win", lambda x: x == t)))
    first = F.array_position(F.transform(spans, lambda s: need(s)), True)
    found = found.withColumn("b", first.cast("int") - 1).where("b >= 0")
    return tokens, found.select("doc_id", "key", F.greatest(F.col("start") - F.col("b"), F.lit(0)).alias("start"), F.size(F.element_at(spans, F.col("b") + 1)).alias("len"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``doc_id, key, n_words, n_hit, items, contaminated``, one row a document.

    ``items`` are the ids, sorted, of the test items of which a window occurs; ``n_hit``
    counts the words inside any occurrence.

    Defined cases: a null text has no words; a null or wordless item has no windows;
    repeated documents are judged alike; an item without id is ignored, its windows too; extra columns are
    ignored; without documents there is no row, without items none is contaminated.
    """
    tokens, found = occurrences(docs, items, width, slop)
    each = found.groupBy("doc_id", "key", "start").agg(F.max("len").alias("len"), F.flatten(F.collect_set("items")).alias("items"))
    spans = F.sort_array(F.collect_list(F.struct("start", F.col("len").alias("len"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))

    hits = each.groupBy("doc_id", "key").agg(
        F.aggregate(spans, zero, cover)["n"].alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    h = hits.select(F.col("doc_id").alias("h_doc_id"), F.col("key").alias("h_key"), "n_hit", "items")
    d = tokens.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    d = d.join(h, (F.col("key") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_doc_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return d.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    d = decontaminate(read("documents"), read("benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item_id, words[i:i + 9] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)
), lens AS (
  SELECT DISTINCT len(win) AS n FROM w
), s AS (
  SELECT rid, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens WHERE len(words) >= n
), o AS (
  SELECT s.rid, s.i, s.n, w.item_id
  FROM s JOIN d USING (rid) JOIN w ON w.win = d.words[s.i:s.i + s.n - 1]
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM o)) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
