"""Every registered query with an oracle gives the oracle's rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tracesift.plans.bindings import TABLES
from tracesift.session import ensure_checkpoint_dir

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    mine = QUERIES[name](spark, FOLDER)
    columns = sorted(mine.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in mine.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_stream_takes_a_delivery_a_batch(spark, duck, tmp_path):
    """A table in many files makes no more micro-batches than one in a single file."""
    lineitem = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    lineitem.repartition(12).write.parquet(str(tmp_path / "lineitem.parquet"))
    home = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    known = set(home.glob("stream-*"))
    got = QUERIES["stream_deny_windows"](spark, str(tmp_path)).count()
    assert got == duck.execute(f"SELECT count(*) FROM ({ORACLES['stream_deny_windows']}) q").fetchone()[0]
    (folder,) = set(home.glob("stream-*")) - known
    assert len(list((folder / "state" / "commits").glob("[0-9]*"))) <= 20


def test_chunk_files_share_folders(spark, tmp_path):
    """Files of chunk results, one a report, lie in a bounded number of folders."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.withColumn("user_id", events["event_id"] % 600).write.parquet(str(tmp_path / "events.parquet"))
    home = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    known = set(home.glob("files-*"))
    got = QUERIES["files_artifacts"](spark, str(tmp_path))
    assert got.select("report_path").distinct().count() == 600
    (folder,) = set(home.glob("files-*")) - known
    files = list(folder.rglob("*.txt"))
    assert len(files) == 600
    assert len({f.parent for f in files}) <= 256


@pytest.mark.parametrize("name", ["files_artifacts", "files_report_list"])
def test_scratch_files_have_no_checksum_files(spark, name):
    """On a local disk each would take as long as the file it belongs to."""
    home = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    known = set(home.glob("files-*"))
    assert QUERIES[name](spark, FOLDER).count()
    (folder,) = set(home.glob("files-*")) - known
    assert len(list(folder.rglob("part-*.txt"))) > 1
    assert not list(folder.rglob(".part-*.txt.crc"))
