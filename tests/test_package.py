"""Python steps work where only the driver can import the package."""

import os
import subprocess
import sys
import zipfile
from io import BytesIO
from pathlib import Path

from strandline.sources.package import archive

ROOT = Path(__file__).resolve().parents[1]

STEPS = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from strandline.sources import archive, records
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2] + "/shared").getOrCreate()
archive.write_archive(sys.argv[2] + "/a.tar.zst", {"nodes.jsonl": ["{}", "[]"], "x/nodes.jsonl": ["3"], "edges.jsonl": ["1"]})
archive.register(spark)
rows = spark.read.format("record_archive").option("path", sys.argv[2] + "/a.tar.zst").load()
records.write_lines(rows.select("value"), sys.argv[2] + "/lines", "zstd")
print("ROWS", sorted(tuple(r) for r in rows.collect()))
"""


def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", STEPS, str(ROOT), str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [('edges.jsonl', '1'), ('nodes.jsonl', '[]'), ('nodes.jsonl', '{}')]" in got.stdout, got.stderr[-2000:]
    assert list((tmp_path / "lines").glob("*.zst"))


def test_archive_holds_the_whole_package():
    data = archive()
    names = set(zipfile.ZipFile(BytesIO(data)).namelist())
    assert names == {str(p.relative_to(ROOT)) for p in (ROOT / "strandline").rglob("*.py")} and data == archive()
