import pytest

from millrace.queries import core
from tests.oracle import same

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, data, name):
    same(spark, data, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_redaction_in_sql():
    """The SQL of redaction, held against a plain way to say it."""
    import random

    import duckdb

    from millrace.queries.operators import _redacted
    from tests.test_text import ADDRESSES, by_runs

    rng = random.Random(4)
    texts = [*ADDRESSES, *("".join(rng.choice("ab1@.-_/ é") for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INT, v VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = [r[0] for r in c.execute(f"SELECT {_redacted('v')} FROM t ORDER BY i").fetchall()]
    assert [(t, g) for t, g in zip(texts, got)] == [(t, by_runs(t)) for t in texts]


def test_a_missing_part_of_the_text_package_is_an_error(tmp_path):
    """Without the package of text operators the entry has fewer queries; with a broken one it fails."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"]
    assert subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True).stdout.strip() == str(len(core.QUERIES))
    (tmp_path / "millrace" / "llm").mkdir()
    (tmp_path / "millrace" / "llm" / "__init__.py").write_text("")
    (tmp_path / "millrace" / "llm" / "queries.py").write_text("import millrace.nowhere\n")
    assert subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True).returncode != 0
