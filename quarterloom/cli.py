"""Command line: build, baselines, evaluate, validate, report-drift, record, download.

Run as ``python -m quarterloom.cli COMMAND ...``. Exit codes: 0 done, 1 failed or
invalid, 2 nothing to do or unreadable, 3 not verified.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FEATURE_SETS, Task, load_task
from .operators import reshape
from .plans import baselines, build, ledger, masks, scoring, validate
from .sources import download, files, readers

ALL_BASELINES = ("naive", "fade", "elasticnet", "linear")


def session() -> SparkSession:
    return SparkSession.builder.appName("quarterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _task(a: argparse.Namespace) -> Task:
    task = load_task(a.task) if a.task else Task()
    given = {k: v for k, v in (("horizon", a.horizon), ("train_end", a.train_end), ("val_end", a.val_end)) if v is not None}
    return replace(task, **given, **({"items": tuple(FEATURE_SETS[a.items])} if a.items else {}))


def _say(*text: object) -> None:
    print(*text, file=sys.stderr)


def _split(spark: SparkSession, folder: str, tag: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/cells__{tag}").where(F.col("split") == split).drop("split")


def frozen_statistics(spark: SparkSession, choice: str, folder: str, tag: str) -> DataFrame | None:
    """The statistics that define the target space; None to estimate them.

    ``frozen`` (the default) looks for ``frozen_stats__{tag}``, then ``frozen_stats``, in the build's
    folder. Two builds with different statistics share hardly any target, so a choice
    that can't be met is an error and never an estimate.
    """
    if choice == "estimate":
        _say("statistics: estimated from this panel; scores are not comparable with others' targets")
        return None
    options = [f"{folder}/frozen_stats__{tag}", f"{folder}/frozen_stats"] if choice == "frozen" else [choice]
    for path in options:
        if files.exists(spark, path):
            _say(f"statistics: frozen, {path}")
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no frozen statistics at {' or '.join(options)}; give their path, or --stats estimate for a target space of your own")


def cmd_build(a: argparse.Namespace) -> int:
    spark, task = session(), _task(a)
    if not files.exists(spark, a.raw):
        _say(f"no raw panel at {a.raw}; download it first")
        return 2
    try:
        frozen = frozen_statistics(spark, a.stats, a.folder, a.tag)
    except FileNotFoundError as e:
        _say(e)
        return 2
    raw = readers.read_raw_panel(spark, a.raw, task)
    ranges = spark.read.parquet(a.ranges) if a.ranges else None
    built = build.build(raw, task, frozen, ranges)
    build.write(built, a.folder, task, a.tag, tuple(a.views.split(",")))
    if a.report_drift:
        return _print_drift(spark, a)
    if a.record and not a.no_verify:
        found = ledger.verify(spark, a.folder, a.tag, ledger.read_record(spark, a.record))
        for name, status in sorted(found.get("artifacts", {}).items()):
            print(f"{status:>9}  {name}")
        print(found.get("note") or f"all match: {found['all_match']}")
        if not found["all_match"]:
            print("a newer source vintage never matches digest by digest; report-drift says how far apart the builds are")
    return 0


def cmd_baselines(a: argparse.Namespace) -> int:
    spark, task = session(), _task(a)
    if not files.exists(spark, f"{a.folder}/cells__{a.tag}"):
        _say(f"no build {a.tag!r} in {a.folder}")
        return 2
    train, val, test = (_split(spark, a.folder, a.tag, s) for s in ("train", "val", "test"))
    items = [r[0] for r in test.select("item").distinct().orderBy("item").collect()]
    names = a.which.split(",") if a.which else ALL_BASELINES
    for name, f in baselines.run_baselines(names, train, val, test, task, items).items():
        validate.write_forecast(f, f"{a.out}/{name}__predictions.parquet", items, task.horizon)
    return 0


def load_forecasts(spark: SparkSession, paths: list[str], allow_missing: bool = False) -> tuple[dict[str, DataFrame], dict[str, tuple[str, float | None]]]:
    """Forecast tables by model name, first row of a key, and their density families.

    The name is the file's stem without ``__predictions``. A file that can't be read is an
    error unless missing ones are allowed.
    """
    out, families, lost = {}, {}, []
    for p in paths:
        stem = os.path.basename(p.rstrip("/")).removesuffix(".parquet")
        name = stem.removesuffix("__predictions")
        try:
            f = scoring.canonical_keys(readers.read_forecast(spark, p))
            values = ["prediction", *(["sigma"] if "sigma" in f.columns else [])]
            out[name] = scoring.first_wins(f, ("file_path", "row_index"), values)
            side = f"{p.removesuffix('.parquet')}.nll.json"
            families[name] = readers.read_sidecar(files.read_text(spark, side) if files.exists(spark, side) else None)
        except Exception as e:  # noqa: BLE001
            lost.append(f"{name} ({e})")
    if lost and not allow_missing:
        raise RuntimeError(f"{len(lost)} forecasts can't be read, which would change the common sample: {'; '.join(lost)}")
    return out, families


def truth_table(spark: SparkSession, a: argparse.Namespace, horizon: int) -> DataFrame | None:
    """The truth: a wide table that is named, else the test cells of a build; None if neither is there."""
    if a.truth:
        if not files.exists(spark, a.truth):
            return None
        wide = readers.read_table(spark, a.truth, aliases={"firm_id": "firm", "quarter": "qord", "origin": "qord"})
        t = reshape.wide_truth(wide)
        return scoring.canonical_keys(t).where(F.col("horizon") <= horizon)
    if not files.exists(spark, f"{a.folder}/cells__{a.tag}"):
        return None
    return scoring.canonical_keys(baselines.truth_cells(_split(spark, a.folder, a.tag, "test"), horizon))


def cmd_evaluate(a: argparse.Namespace) -> int:
    spark = session()
    horizon = _task(a).horizon
    truth = truth_table(spark, a, horizon)
    if truth is None:
        _say(f"no truth at {a.truth or a.folder}")
        return 2
    paths = list(a.forecasts)
    if a.against == "baselines":
        named = {os.path.basename(p) for p in paths}
        have = files.children(spark, a.baseline_dir)
        paths += [f"{a.baseline_dir}/{n}__predictions.parquet" for n in ALL_BASELINES if f"{n}__predictions.parquet" in have and f"{n}__predictions.parquet" not in named]
    forecasts, families = load_forecasts(spark, paths, a.allow_missing)
    if not forecasts:
        _say("no forecast to evaluate")
        return 2
    mask = masks.resolve(spark, a.sample_mask, truth, a.grid_rows, horizon) if a.sample_mask else None
    cells = scoring.scored_cells(truth, forecasts, families, mask).persist()
    scores = scoring.metrics(cells, truth).persist()
    scoring.leaderboard(scores, a.sort).show(100, False)
    if a.counts:
        for name, f in forecasts.items():
            print(name, json.dumps(scoring.match_counts(f, truth).first().asDict()))
    if a.out:
        for level in scoring.LEVELS.values():
            for m in scoring.METRICS:
                if scores.where(F.col("level") == level).where(F.col(m).isNotNull()).limit(1).count():
                    scoring.pivot_metric(scores, level, m, sorted(forecasts)).coalesce(1).write.mode("overwrite").csv(f"{a.out}/{m}__{level}", header=True)
        scoring.leaderboard(scores, a.sort).coalesce(1).write.mode("overwrite").csv(f"{a.out}/leaderboard", header=True)
    return 1 if scoring.common_sample_violations(cells).limit(1).count() else 0


def cmd_validate(a: argparse.Namespace) -> int:
    spark, worst = session(), 0
    horizon = _task(a).horizon
    for p in a.forecasts:
        try:
            problems, warnings = validate.validate_forecast(readers.read_table(spark, p, aliases=scoring.ALIASES), horizon=horizon)
        except Exception as e:  # noqa: BLE001
            print(f"{p}: unreadable: {e}")
            worst = max(worst, 2)
            continue
        for kind, texts in (("problem", problems), ("warning", warnings)):
            for t in texts:
                print(f"{p}: {kind}: {t}")
        worst = max(worst, int(bool(problems)))
    return worst


def _print_drift(spark: SparkSession, a: argparse.Namespace) -> int:
    here = ledger.artifacts(spark, a.folder, a.tag)
    if not here:
        _say(f"nothing is built as {a.tag!r} in {a.folder}")
        return 2
    if a.reference and not ledger.artifacts(spark, a.reference, a.tag):
        _say(f"nothing to compare with in {a.reference}")
        return 2
    if not a.reference and not a.record:
        _say("no reference build and no record: nothing to compare with")
        print("verdict: INDETERMINATE")
        return 0
    try:
        pinned = ledger.record(spark, a.reference, a.tag) if a.reference else ledger.read_record(spark, a.record)
        stats = files.read_json(spark, a.column_stats) if a.column_stats else None
    except Exception as e:  # noqa: BLE001
        print(f"the reference can't be read: {e}\nverdict: NOT VERIFIED")
        return 3
    found = ledger.report(spark, a.folder, a.tag, pinned, stats, reference=a.reference)
    for name, e in sorted(found["artifacts"].items()):
        if "verdict" in e:
            print(f"[{e['verdict']}] {name}: {e['row_delta']:+d} rows, {e['n_over']} of {e['n_cols']} columns beyond tolerance, {e['n_one_sided']} on one side only; worst mean {e['worst_mean']} ({e['worst_mean_column']}); {', '.join(e['columns_over'] or [])}")
        else:
            print(f"{e.get('status') or ('same digest' if e['digest_match'] else 'other digest')}  {name}")
    for kind, e in found.get("ids", {}).items():
        if kind != "ok":
            print(f"{kind} ids: {e['status']} {e.get('first_differences') or ''}")
    for k in ("stats_source", "note"):
        if found.get(k):
            print(f"{k}: {found[k]}")
    print(f"verdict: {found['verdict']}")
    return {"PASS": 0, "INDETERMINATE": 0, "FAIL": 1}.get(found["verdict"], 3)


def cmd_report_drift(a: argparse.Namespace) -> int:
    return _print_drift(session(), a)


def cmd_record(a: argparse.Namespace) -> int:
    spark = session()
    if not ledger.artifacts(spark, a.folder, a.tag):
        _say(f"nothing is built as {a.tag!r} in {a.folder}")
        return 2
    given = {k: v for k in ledger.METADATA if (v := getattr(a, k)) is not None}
    for w in ledger.write_record(spark, a.folder, a.tag, a.out, a.with_stats, **given):
        _say(f"warning: {w}")
    return 0


def cmd_mask(a: argparse.Namespace) -> int:
    """Cells that truth and a forecast both know, as keys or packed bits, with the row index."""
    spark, task = session(), _task(a)
    truth = truth_table(spark, a, task.horizon)
    if truth is None:
        _say(f"no truth at {a.truth or a.folder}")
        return 2
    keys = masks.build_mask(scoring.canonical_keys(readers.read_forecast(spark, a.forecast)), truth)
    if not a.out.endswith(".npy"):
        keys.write.mode("overwrite").parquet(a.out)
        return 0
    grid = masks.grid_rows(truth).persist()
    rows, names = grid.count(), sorted(r[0] for r in truth.select("target").distinct().collect())
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("target")) - 1
    cells = keys.join(grid, ["firm", "origin"]).select(masks.cell_address(at, F.col("horizon"), F.col("grid_row"), task.horizon, rows).alias("cell"))
    masks.write_bits(spark, a.out, masks.pack(cells, len(names) * task.horizon * rows))
    masks.write_grid_rows(grid, a.out.removesuffix(".npy") + "_rows")
    return 0


def cmd_download(a: argparse.Namespace) -> int:
    spark, task = session(), _task(a)
    source = download.Source(a.table, a.industry or None, a.links or None)
    properties = {k: v for k, v in (("user", a.user), ("driver", a.driver)) if v}
    try:
        download.download(spark, a.url, a.folder, task, source, properties, a.chunk_years, a.start_year, a.end_year, ["*"] if a.all_columns else None)
    except download.LoginFailed as e:
        _say(e)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarterloom", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--tag", default="default")
        c.add_argument("--task", help="a document that overrides the task's fields")
        c.add_argument("--items", choices=sorted(FEATURE_SETS))
        c.add_argument("--horizon", type=int)
        c.add_argument("--train-end", type=int)
        c.add_argument("--val-end", type=int)
        return c

    def drift_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--reference", help="a folder with a build to compare with")
        c.add_argument("--record", help="a record to compare with")
        c.add_argument("--column-stats", help="a document of column statistics that belongs to the record")

    c = command("build", cmd_build)
    c.add_argument("raw")
    c.add_argument("folder")
    c.add_argument("--stats", default="frozen", help="frozen, estimate, or a path")
    c.add_argument("--ranges")
    c.add_argument("--views", default="cells,tuple,tabular")
    c.add_argument("--report-drift", action="store_true")
    c.add_argument("--no-verify", action="store_true")
    drift_options(c)
    c = command("baselines", cmd_baselines)
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--which", help="comma list; all four without")
    c = command("evaluate", cmd_evaluate)
    c.add_argument("folder")
    c.add_argument("forecasts", nargs="*")
    c.add_argument("--truth", help="a wide truth table instead of the build's test cells")
    c.add_argument("--against", choices=["baselines"])
    c.add_argument("--baseline-dir", default="results/forecasts")
    c.add_argument("--sort", default="r2", choices=scoring.METRICS)
    c.add_argument("--allow-missing", action="store_true")
    c.add_argument("--sample-mask", help="a table of keys, or .npy bits over the grid")
    c.add_argument("--grid-rows", help="the row index of the bits' grid")
    c.add_argument("--counts", action="store_true", help="print each forecast's matched, unmatched and repeated rows")
    c.add_argument("--out")
    c = command("validate", cmd_validate)
    c.add_argument("forecasts", nargs="+")
    c = command("report-drift", cmd_report_drift)
    c.add_argument("folder")
    drift_options(c)
    c = command("record", cmd_record)
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--with-stats", action="store_true")
    for k in ledger.METADATA:
        c.add_argument(f"--{k.replace('_', '-')}", dest=k)
    c = command("mask", cmd_mask)
    c.add_argument("folder")
    c.add_argument("forecast")
    c.add_argument("out")
    c.add_argument("--truth")
    c = command("download", cmd_download)
    c.add_argument("url")
    c.add_argument("table")
    c.add_argument("folder")
    c.add_argument("--industry", default="co_industry")
    c.add_argument("--links", default="link_table")
    c.add_argument("--user")
    c.add_argument("--driver")
    c.add_argument("--chunk-years", type=int, default=1)
    c.add_argument("--start-year", type=int)
    c.add_argument("--end-year", type=int)
    c.add_argument("--all-columns", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
