import os

import pytest
from pyspark.sql import functions as F
from test_plans import raw_panel

from quarterloom import cli
from quarterloom.config import Task
from quarterloom.plans import ledger
from quarterloom.sources import download, files


def test_whole_workflow_on_the_command_line(spark, tmp_path):
    raw, out, fc = (str(tmp_path / n) for n in ("raw", "built", "forecasts"))
    spark.createDataFrame(raw_panel(8, 2000, 2012)).write.parquet(raw)
    common = ["--items", "core", "--horizon", "2"]
    assert cli.main(["baselines", *common, out, fc]) == 2
    assert cli.main(["evaluate", *common, out, "x"]) == 2
    # the target space is never chosen silently
    assert cli.main(["build", *common, raw, out]) == 2
    assert cli.main(["build", *common, f"{raw}_none", out]) == 2
    assert cli.main(["build", *common, raw, out, "--stats", "estimate"]) == 0
    other, ledger_path = str(tmp_path / "other"), str(tmp_path / "record.json")
    spark.read.parquet(f"{out}/stats__default").write.parquet(f"{other}/frozen_stats")
    assert cli.main(["record", out, ledger_path]) == 0
    assert cli.main(["build", *common, raw, other, "--record", ledger_path]) == 0
    assert cli.main(["build", *common, raw, other, "--report-drift", "--reference", out]) == 0
    assert cli.main(["baselines", *common, out, fc, "--which", "naive,fade,linear"]) == 0
    made = [f"{fc}/{n}__predictions.parquet" for n in ("naive", "fade")]
    assert cli.main(["validate", "--horizon", "2", *made]) == 0
    assert cli.main(["validate", "--horizon", "1", *made]) == 1
    assert cli.main(["validate", f"{fc}/none.parquet"]) == 2
    assert cli.main(["evaluate", *common, out, *made, "--out", f"{tmp_path}/scores", "--counts"]) == 0
    assert {"leaderboard", "r2__global", "mae__by_target"} <= set(os.listdir(tmp_path / "scores"))
    assert cli.main(["evaluate", *common, out]) == 2
    # the truth as a wide table, baselines by their folder, masks of either kind
    wide, npy = str(tmp_path / "wide"), str(tmp_path / "mask.npy")
    spark.read.parquet(f"{out}/tabular__default").where("split = 'test'").drop("split").withColumnRenamed("qord", "quarter").write.parquet(wide)
    assert cli.main(["evaluate", *common, out, "--truth", wide, "--against", "baselines", "--baseline-dir", fc]) == 0
    assert cli.main(["evaluate", *common, out, *made, "--truth", f"{wide}_none"]) == 2
    assert cli.main(["mask", *common, out, made[1], npy]) == 0
    assert cli.main(["mask", *common, out, made[1], f"{tmp_path}/keys"]) == 0
    for mask in (["--sample-mask", npy], ["--sample-mask", npy, "--grid-rows", f"{tmp_path}/mask_rows"], ["--sample-mask", f"{tmp_path}/keys"]):
        assert cli.main(["evaluate", *common, out, *made, *mask]) == 0
    with pytest.raises(RuntimeError, match="can't be read"):
        cli.main(["evaluate", *common, out, *made, f"{fc}/none__predictions.parquet"])
    # drift
    assert cli.main(["report-drift", out, "--reference", out]) == 0
    assert cli.main(["report-drift", out, "--reference", f"{tmp_path}/none"]) == 2
    assert cli.main(["report-drift", f"{tmp_path}/none", "--reference", out]) == 2
    assert cli.main(["report-drift", out, "--record", ledger_path]) == 0  # digests only: nothing to judge by
    files.write_text(spark, ledger_path, "no json")
    assert cli.main(["report-drift", out, "--record", ledger_path]) == 3


def test_ledger_verdicts(spark, tmp_path):
    folder = str(tmp_path / "b")
    df = spark.range(400).select(F.col("id").cast("string").alias("firm"), F.lit(8000).alias("qord"), (F.col("id") / 100).cast("float").alias("x_level_0"), F.lit("test").alias("split"))
    df.write.partitionBy("split").parquet(f"{folder}/tabular__t")
    full = ledger.record(spark, folder, "t")
    assert full["artifacts"]["tabular/test"]["n_rows"] == 400
    verdict = lambda doc, *a, **k: ledger.report(spark, folder, "t", doc, *a, **k)["verdict"]
    assert ledger.verify(spark, folder, "t", full)["all_match"] and verdict(full) == "PASS"
    bare = ledger.record(spark, folder, "t", with_stats=False)
    assert verdict(bare) == "INDETERMINATE"
    stats = ledger.stats_document(full, bare)
    assert verdict(bare, stats) == "PASS"
    assert verdict({**bare, "tag": "u"}) == verdict({"status": "empty"}) == "INDETERMINATE"
    # statistics of another build, of other rows, without content: nothing is compared
    name = "tabular/test"
    for doc in ({**stats, "tag": "u"}, {**stats, "artifacts": {name: {**stats["artifacts"][name], "n_rows": 5}}}, {**stats, "artifacts": {name: {"n_rows": 400}}}, {**stats, "artifacts": {name: {"n_rows": 400, "column_stats": {"x_level_0": {"mean": "much"}}}}}):
        assert verdict(bare, doc) == "NOT VERIFIED"
    assert verdict({**full, "artifacts": {**full["artifacts"], "tabular/val": full["artifacts"][name]}}) == "FAIL"
    with pytest.raises(ValueError, match="rows"):
        ledger.stats_document({**full, "artifacts": {name: {**full["artifacts"][name], "n_rows": 1}}}, bare)
    with pytest.raises(ledger.Malformed):
        ledger.checked({"artifacts": {"a": 1}})
    moved = str(tmp_path / "m")
    df.withColumn("x_level_0", F.col("x_level_0") + 1).write.partitionBy("split").parquet(f"{moved}/tabular__t")
    assert ledger.report(spark, moved, "t", full)["verdict"] == "FAIL" and ledger.verify(spark, moved, "t", full)["artifacts"] == {name: "mismatch"}
    # metadata is carried forward, with a warning where it is unknown
    path = str(tmp_path / "r.json")
    assert len(ledger.write_record(spark, folder, "t", path, task_version="1", stats_source="a build")) == 1
    assert len(ledger.write_record(spark, folder, "t", path, with_stats=True, download_date="2024-01-01")) == 1
    again = ledger.read_record(spark, path)
    assert again["task_version"] == "1" and again["download_date"] == "2024-01-01" and "column_stats" in again["artifacts"][name]
    # id dictionaries: order counts for items, rule and number for firms
    assert ledger.check_ids(spark, folder, "t", None) is None
    for where, items in ((folder, ["a", "b"]), (moved, ["b", "a"])):
        for kind, names in (("firm", ["f", "g"]), ("account", items)):
            col = "item" if kind == "account" else "firm"
            spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, {kind}_id long").coalesce(1).write.csv(f"{where}/{kind}_ids__t", header=True)
    ids = ledger.check_ids(spark, folder, "t", moved)
    assert not ids["ok"] and ids["account"]["status"] == "differs" and ids["firm"]["status"] == "ok" and ledger.check_ids(spark, folder, "t", folder)["ok"]


def test_files(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "f")
    files.write_text(spark, path, "héllo")
    files.write_text(spark, path, "second")
    assert files.read_text(spark, path) == "second" and sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["f"]
    digest = hashlib.md5(b"second").hexdigest()
    assert files.md5(spark, path) == digest
    files.verify_md5(spark, path, digest.upper())
    with pytest.raises(files.DigestMismatch):
        files.verify_md5(spark, path, "0" * 32)
    with pytest.raises(ValueError, match="JSON"):
        files.read_json(spark, path)


URL = "jdbc:derby:memory:source;create=true"


def test_download_over_one_login(spark, tmp_path, monkeypatch):
    opened = []
    monkeypatch.setattr(download.OneLogin, "__init__", (lambda f: lambda self, *a, **k: (opened.append(1), f(self, *a, **k))[1])(download.OneLogin.__init__))
    task = Task(items=("niq",), first_year=2000, last_year=2003, row_filters=(("consol", "C"), ("popsrc", "D")))
    monkeypatch.setattr(download, "declared_types", lambda db, table: {})
    with download.OneLogin(spark, URL) as db:
        run = db.connection.createStatement().execute
        run("create table fundq (gvkey varchar(6), datadate date, fyearq int, fqtr int, niq double, ltq double, seqq double, atq double, consol varchar(2), popsrc varchar(2))")
        run("create table co_industry (gvkey varchar(6), datadate date, sich int, naicsh varchar(8), consol varchar(2), popsrc varchar(2))")
        run("create table link_table (gvkey varchar(6), linkdt date, linkenddt date, lpermno int, lpermco int, linktype varchar(2), linkprim varchar(2))")
        for g, d, consol in (("001", "2000-03-31", "C"), ("001", "2002-03-31", "C"), ("002", "2001-06-30", "C"), ("003", "2001-06-30", "C"), ("001", "2001-03-31", "X")):
            run(f"insert into fundq values ('{g}', '{d}', {d[:4]}, 1, 1.5, 2, 3, 4, '{consol}', 'D')")
        for g, d, s in (("001", "1999-01-01", 2000), ("001", "2001-01-01", 3000), ("003", "1999-01-01", 6500)):
            run(f"insert into co_industry values ('{g}', '{d}', {s}, '1', 'C', 'D')")
        run("insert into link_table values ('001', '2001-01-01', null, 77, 78, 'LU', 'P')")
    opened.clear()
    path = download.download(spark, URL, str(tmp_path), task)
    assert len(opened) == 1
    got = {(r["gvkey"], str(r["datadate"]), r["sich"], r["permno"]) for r in spark.read.parquet(path).collect()}
    # a linked firm loses the row before its link, one without link stays, a bank goes
    assert got == {("001", "2002-03-31", 3000, 77), ("002", "2001-06-30", None, None)}
    # windows are reused: the table may be gone
    with download.OneLogin(spark, URL) as db:
        db.connection.createStatement().execute("drop table fundq")
    download.download(spark, URL, str(tmp_path), task)
    # what can be checked is checked before a login; a failed one isn't repeated
    opened.clear()
    with pytest.raises(ValueError):
        download.download(spark, URL, str(tmp_path), task, first=2005, last=2004)
    assert not opened
    with pytest.raises(download.LoginFailed):
        download.download(spark, "jdbc:derby:memory:absent", str(tmp_path), task)
    assert len(opened) == 1 and cli.main(["download", "jdbc:derby:memory:absent", "fundq", str(tmp_path)]) == 1
    monkeypatch.setattr(download, "declared_types", lambda db, table: {"gvkey": "text"})
    with pytest.raises(KeyError, match="niq"):
        download.download(spark, URL, str(tmp_path), task)
