"""The driver's memory between the steps of a pipeline."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from quarterloom.llm import common, mixing, simhash


def test_tidy_returns_what_the_jvm_has_freed(spark):
    status = Path(f"/proc/{spark.sparkContext._gateway.proc.pid}/smaps_rollup")
    if not status.exists():
        pytest.skip("needs Linux")

    def mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", status.read_text()))) / 1024

    deflater = spark._jvm.java.util.zip.Deflater
    held = [deflater() for _ in range(600)]  # some 150 kB of native memory each
    for d in held[:-1]:
        d.end()
    for _ in range(2):
        spark._jvm.System.gc()
    before = mb()
    common.tidy(spark)
    held[-1].end()
    assert mb() < before - 40


def test_loops_and_stages_tidy_up(spark, monkeypatch):
    calls = []
    for module in (common, mixing, simhash):
        monkeypatch.setattr(module, "tidy", lambda s: calls.append(s))
    assert simhash.components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")).count() == 2
    assert len(calls) >= 2
    for name, stage in corpus_pipeline.STAGES:
        calls.clear()
        with pytest.raises(Exception):  # noqa: B017, PT011
            stage(spark, None, "")  # there are no rows; it tidies before it looks for them
        assert calls, name
