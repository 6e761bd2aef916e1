"""Every registered query runs, and equals its SQL where it has one."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from histomill.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("supplier", "part", "events", "embeddings", "lineitem", "nation", "region")
SLOW = {"differential_abundance_pvalues", "spatial_domains_kmeans", "run_harmony", "cluster_graph"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def spelled(frame):
    columns = sorted(frame.columns)
    spell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(spell, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert spelled(got) == spelled(want)


@pytest.fixture(scope="module")
def short_sections(spark, data, con, tmp_path_factory):
    """Tables whose last sections have few pixels: 6, and 1 behind a gap."""
    folder = tmp_path_factory.mktemp("short")
    con.execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 306 OR vec_id = 350) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["spatial_organization", "differential_spatial_organization", "hotspot_fraction"])
def test_short_sections(spark, short_sections, name):
    folder, con = short_sections
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLES[name]).df()
    floats = want.select_dtypes("float").columns
    want[floats] += 0.0  # no negative zero
    assert len(got) == len(want) and spelled(got) == spelled(want)


def test_means_of_halves_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Half of the users move by the same amount up, half down; only the last bits of the means tell
    the changes apart, so the ranks are those of the SQL if values are added up in its order."""
    r = np.random.default_rng(8)
    rows, at = [], 0
    for half in (0, 1):
        for user in range(60):
            for v in r.permutation([0.1, 0.2, 0.3, 0.7, 1.1, 2.3, 3.3]):
                rows.append((at, half * 10_000_000 + at * 1000, user, float(v) + half * (1 if user % 2 else -1) * 0.1))
                at += 1
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE events (event_id BIGINT, us BIGINT, user_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
    con.execute("ALTER TABLE events RENAME TO e")
    con.execute("CREATE TABLE events AS SELECT event_id, make_timestamp(us) AS ts, user_id, 'view' AS event_type, value, '' AS props FROM e ORDER BY event_id")
    con.execute(f"COPY (SELECT * FROM events ORDER BY event_id DESC) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["paired_differential_abundance"](spark, str(tmp_path)).toPandas()
    want = con.execute(catalog.ORACLES["paired_differential_abundance"]).df()
    assert want.n_pairs[0] == 60 and spelled(got) == spelled(want)


def test_entry_imports_without_the_optional_parts(tmp_path):
    for part in ("histomill", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, part), tmp_path / part)
    os.unlink(tmp_path / "histomill")
    import shutil

    shutil.copytree(os.path.join(ROOT, "histomill"), tmp_path / "histomill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=100)
    # the rest runs: a query through the driver's entry, and tests of the rest
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; "
        "s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        "assert e.entry(s).count() and e.queries()['log1p_transform'](s, '/root/testdata/sf0.001').count()"
    )
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    if os.path.isdir("/root/testdata/sf0.001"):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
    tests = ["tests/test_statistics.py", "tests/test_sources.py"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *tests, "-k", "exact or bh or delimiter or number"], cwd=tmp_path, env=env, check=True, timeout=300)
