import subprocess
import sys
import textwrap

from quarterloom import shipping


def test_executors_elsewhere_can_import(tmp_path):
    code = f"""
        import os, sys
        sys.path.insert(0, {str(shipping._ROOT)!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from quarterloom.functions import density
        from quarterloom.shipping import ship
        ship(spark)
        ship(spark)
        print("got", spark.range(1).select(density.crps(F.lit(0.5), F.lit(1.0))).first()[0])
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "got 0.3" in out.stdout, out.stderr[-2000:]
