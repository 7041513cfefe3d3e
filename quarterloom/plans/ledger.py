"""What a build consists of, as a JSON record, and its comparison with another build's.

A record has a status, the build's tag and, for every artifact, its rows, columns, an
order-insensitive digest and, for the tabular view, a digest and a distribution summary of
each column. Digests answer "the same?", summaries "how far apart?".
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import drift

SPLITS = ("train", "val", "test")
POPULATED = "populated"
#: The keys by which a row of an artifact is known, and what a split's table has besides columns.
KEYS = {"stats": ["item", "qord"], "cells": ["firm", "qord", "item"], "tuple": ["firm_id", "account_id", "quarter"], "tabular": ["firm", "qord"]}
METADATA = ("download_date", "task_version", "stats_source")


class Malformed(ValueError):
    """A record doesn't have the shape of one."""


def artifacts(spark: SparkSession, folder: str, tag: str) -> dict[str, DataFrame]:
    """The tables of a build that exist, by name: ``stats``, ``{view}/{split}``."""
    out = {}
    if files.exists(spark, f"{folder}/stats__{tag}"):
        out["stats"] = spark.read.parquet(f"{folder}/stats__{tag}")
    for view in ("cells", "tuple", "tabular"):
        path = f"{folder}/{view}__{tag}"
        for split in SPLITS:
            if files.exists(spark, f"{path}/split={split}"):
                out[f"{view}/{split}"] = spark.read.parquet(f"{path}/split={split}")
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    """The regularised columns: floating ones, dummies aside."""
    return sorted(c for c, t in df.dtypes if t in ("float", "double") and not c.startswith("industry_"))


def record(spark: SparkSession, folder: str, tag: str, with_stats: bool = True) -> dict:
    """The record of a build on disk. ``with_stats`` adds the columns' summaries."""
    out: dict = {"status": POPULATED, "tag": tag, "artifacts": {}}
    for name, df in artifacts(spark, folder, tag).items():
        view = name.split("/")[0]
        prints = drift.fingerprint(df, [k for k in KEYS[view] if k in df.columns])
        entry: dict = {"n_rows": int(prints.pop("n_rows")), "n_cols": len(df.columns), "digest": drift.digest_of(prints)}
        if view == "tabular":
            entry["column_digests"] = prints
            if with_stats:
                entry["column_stats"] = stats_to_json(drift.column_stats(df, numeric_columns(df)))
        out["artifacts"][name] = entry
    return out


def stats_to_json(stats: DataFrame) -> dict[str, dict]:
    """{column: its summary}; a column without values has its counts only."""
    return {(d := r.asDict()).pop("column"): {k: v for k, v in d.items() if v is not None} for r in stats.collect()}


def stats_from_json(spark: SparkSession, doc: dict[str, dict]) -> DataFrame:
    schema = "column string, n_finite long, coverage double, mean double, sd double, p05 double, p50 double, p95 double"
    num = lambda v: None if v is None else float(v)
    try:
        rows = [(c, int(v["n_finite"]), *(num(v.get(k)) for k in ("coverage", "mean", "sd", "p05", "p50", "p95"))) for c, v in doc.items()]
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise Malformed(f"column statistics can't be read: {e!r}") from e
    return spark.createDataFrame(rows, schema)


def checked(doc: dict) -> dict:
    """``doc`` if it has a record's shape, else Malformed."""
    if not isinstance(doc.get("artifacts", {}), dict) or any(not isinstance(e, dict) for e in doc.get("artifacts", {}).values()):
        raise Malformed("a record maps artifacts to objects")
    return doc


def write_record(spark: SparkSession, folder: str, tag: str, path: str, with_stats: bool = False, **metadata: str | None) -> list[str]:
    """Write a build's record; returns warnings.

    Metadata (download_date, task_version, stats_source) that isn't given is carried
    forward from the record that is there. Summaries are left out unless asked for, since a
    public record shouldn't carry what follows from licensed data.
    """
    unknown = set(metadata) - set(METADATA)
    if unknown:
        raise ValueError(f"no such metadata: {', '.join(sorted(unknown))}")
    prior: dict = {}
    if files.exists(spark, path):
        try:
            prior = files.read_json(spark, path)
        except ValueError:
            prior = {}
    doc, warnings = record(spark, folder, tag, with_stats), []
    for k in METADATA:
        value = metadata.get(k) or prior.get(k)
        if value is not None:
            doc[k] = value
        elif k != "stats_source":
            warnings.append(f"{k} is neither given nor in the record before")
    if with_stats and not metadata.get("stats_source") and prior.get("stats_source"):
        warnings.append("stats_source is carried forward, but the statistics are new")
    files.write_text(spark, path, drift.to_json(doc))
    return warnings


def read_record(spark: SparkSession, path: str) -> dict:
    return checked(files.read_json(spark, path))


def stats_document(reference: dict, pinned: dict) -> dict:
    """The summaries of ``reference`` as a document of their own, for the artifacts that ``pinned`` pins.

    Refuses where rows or columns differ: such statistics would describe another build.
    """
    out: dict = {"tag": pinned.get("tag"), "artifacts": {}}
    for name, p in pinned.get("artifacts", {}).items():
        if not name.startswith("tabular/"):
            continue
        r = reference.get("artifacts", {}).get(name)
        if r is None or "column_stats" not in r:
            raise ValueError(f"{name} has no statistics in the reference")
        if r["n_rows"] != p["n_rows"]:
            raise ValueError(f"{name} has {r['n_rows']} rows in the reference, {p['n_rows']} are pinned")
        want, have = set(p.get("column_digests", r["column_stats"])), set(r["column_stats"])
        if not have <= want:
            raise ValueError(f"{name} has columns that aren't pinned: {', '.join(sorted(have - want)[:5])}")
        out["artifacts"][name] = {"n_rows": r["n_rows"], "column_stats": r["column_stats"]}
    if reference.get("stats_source"):
        out["stats_source"] = reference["stats_source"]
    return out


def attach_stats(pinned: dict, stats: dict) -> dict:
    """``pinned`` with the summaries of a statistics document.

    Another tag is an error. An artifact that isn't pinned, has summaries already, or has
    another number of rows is left as it is.
    """
    a, b = pinned.get("tag"), stats.get("tag")
    if a and b and a != b:
        raise ValueError(f"the statistics are of {b!r}, the record of {a!r}")
    out = {**pinned, "artifacts": {k: dict(v) for k, v in checked(pinned).get("artifacts", {}).items()}}
    for name, s in checked(stats).get("artifacts", {}).items():
        e = out["artifacts"].get(name)
        if e is None or "column_stats" in e or (None not in (e.get("n_rows"), s.get("n_rows")) and e["n_rows"] != s["n_rows"]):
            continue
        if "column_stats" not in s:
            raise Malformed(f"{name} has no column statistics")
        e["column_stats"] = s["column_stats"]
    if stats.get("stats_source"):
        out["stats_source"] = stats["stats_source"]
    return out


def verify(spark: SparkSession, folder: str, tag: str, pinned: dict) -> dict:
    """Each artifact ok, mismatch, missing or extra by its digest, and ``all_match``."""
    if pinned.get("status") != POPULATED:
        return {"all_match": False, "note": "the record is not populated"}
    short = lambda d: {n: {"digest": e.get("digest")} for n, e in d.get("artifacts", {}).items()}
    status, same = drift.verify(short(record(spark, folder, tag, False)), short(checked(pinned)))
    return {"artifacts": status, "all_match": same}


def check_ids(spark: SparkSession, folder: str, tag: str, reference: str | None, tolerance: float = 0.01) -> dict | None:
    """The id dictionaries against a reference build's; None where the build has none.

    Items and industries must be the same in the same order. Firms come and go between
    vintages: their ids must follow the names' order and their number be within ``tolerance``.
    """
    here = {n: f"{folder}/{n}_ids__{tag}" for n in ("firm", "account", "industry")}
    if not any(files.exists(spark, p) for p in here.values()):
        return None
    out: dict = {}
    for kind, name in (("account", "item"), ("industry", "industry")):
        there = f"{reference}/{kind}_ids__{tag}" if reference else None
        if not there or not files.exists(spark, there):
            out[kind] = {"status": "no reference"}
        elif not files.exists(spark, here[kind]):
            out[kind] = {"status": "missing"}
        else:
            a, b = (spark.read.schema(f"`{name}` string, `{kind}_id` long").csv(p, header=True) for p in (here[kind], there))
            diffs = [r.asDict() for r in drift.compare_ids(a, b, name, f"{kind}_id").collect()]
            out[kind] = {"status": "differs" if diffs else "ok", "first_differences": diffs}
    if not files.exists(spark, here["firm"]):
        out["firm"] = {"status": "missing"}
    else:
        read = lambda p: spark.read.schema("firm string, firm_id long").csv(p, header=True)
        there = f"{reference}/firm_ids__{tag}" if reference else None
        expected = read(there).count() if there and files.exists(spark, there) else 0
        problems = drift.check_firm_ids(read(here["firm"]), expected, tolerance)
        out["firm"] = {"status": "; ".join(problems) or "ok", "expected": expected}
    out["ok"] = all(v["status"] in ("ok", "no reference") for k, v in out.items() if k != "ok")
    return out


def report(spark: SparkSession, folder: str, tag: str, pinned: dict, stats: dict | None = None, limits: drift.Thresholds = drift.Thresholds(), reference: str | None = None) -> dict:
    """How far a build is from a record, with a verdict: PASS, FAIL, NOT VERIFIED or INDETERMINATE.

    A pinned artifact that is missing fails. Another tag, or a record that isn't populated,
    can't be compared: INDETERMINATE. Where summaries are promised by ``stats`` but can't
    be read or don't apply, nothing was compared: NOT VERIFIED, never a pass.
    """
    if pinned.get("status") != POPULATED:
        return {"verdict": "INDETERMINATE", "note": "the record is not populated", "artifacts": {}}
    if pinned.get("tag") and pinned["tag"] != tag:
        return {"verdict": "INDETERMINATE", "note": f"this build is {tag!r}, the record is of {pinned['tag']!r}", "artifacts": {}}
    here, error = artifacts(spark, folder, tag), None
    try:
        pinned = checked(pinned)
        if stats is not None:
            pinned = attach_stats(pinned, stats)
    except (ValueError, KeyError) as e:
        error = str(e)
        pinned = pinned if isinstance(pinned.get("artifacts"), dict) else {**pinned, "artifacts": {}}
    out: dict = {"artifacts": {}, "thresholds": asdict(limits)}
    verdicts, compared, unverified = [], 0, []
    for name, p in pinned.get("artifacts", {}).items():
        if name not in here:
            out["artifacts"][name] = {"status": "missing"}
            verdicts.append("FAIL")
            continue
        df = here[name]
        prints = drift.fingerprint(df, [k for k in KEYS[name.split("/")[0]] if k in df.columns])
        n = int(prints.pop("n_rows"))
        entry: dict = {"digest_match": drift.digest_of(prints) == p.get("digest"), "n_rows": n}
        if name.startswith("tabular/"):
            before = p.get("n_rows", n)
            entry["row_delta"] = n - before
            if "column_stats" in p:
                try:
                    there = stats_from_json(spark, p["column_stats"])
                    built = drift.column_stats(df, numeric_columns(df))
                    row = drift.summarize(drift.compare_stats(built, there, limits), n, before, limits).first().asDict()
                    verdicts.append("FAIL" if row["verdict"] != "PASS" else "PASS")
                    compared += 1
                    entry |= row
                except Malformed as e:
                    error = error or f"{name}: {e}"
                    unverified.append(name)
            elif stats is not None:
                unverified.append(name)
        out["artifacts"][name] = entry
    out["artifacts"] |= {n: {"status": "extra"} for n in here if n not in out["artifacts"]}
    ids = check_ids(spark, folder, tag, reference)
    if ids is not None:
        out["ids"] = ids
    if unverified and error is None:
        error = f"the statistics don't apply to {', '.join(sorted(unverified))}"
    if error is not None and (not compared or unverified):
        out |= {"verdict": "NOT VERIFIED", "note": error}
    elif "FAIL" in verdicts or (ids is not None and not ids["ok"]):
        out["verdict"] = "FAIL"
    else:
        out["verdict"] = "PASS" if compared else "INDETERMINATE"
    if pinned.get("stats_source"):
        out["stats_source"] = pinned["stats_source"]
    return out
