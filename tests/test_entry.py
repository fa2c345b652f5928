"""The driver's entry points."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from shardloom import catalog


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the smallest tables are not here")
def test_entry(spark):
    rows = {(r.source_db, r.target_db): r.n_rows for r in entry.entry(spark).collect()}
    assert rows and all(n > 0 for n in rows.values())


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_part():
    top = os.path.join(os.path.dirname(entry.__file__), "shardloom")
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name)).read()
                    assert "shardloom.llm" not in text and ".llm" not in text and "corpus_pipeline" not in text


def copy_of_the_repository(tmp_path):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(top, "shardloom"), tmp_path / "shardloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(top, name)):
            shutil.copy(os.path.join(top, name), tmp_path / name)
    return tmp_path


def names_of(top, before=""):
    code = f"{before}\nimport __spark_entry__ as e\nprint(len(e.queries()), 'op4_url_filter' in e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=top, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)


def test_the_optional_part_may_be_missing(tmp_path):
    top = copy_of_the_repository(tmp_path)
    shutil.rmtree(top / "shardloom" / "llm", ignore_errors=True)
    (top / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names_of(top).stdout.split() == [str(len(catalog.QUERIES)), "False"]


@pytest.mark.skipif(not entry._optional, reason="the training-data operators are not here")
def test_a_missing_third_party_module_leaves_the_engine(tmp_path):
    out = names_of(copy_of_the_repository(tmp_path), "import sys; sys.modules['ahocorasick'] = None")
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr


@pytest.mark.skipif(not entry._optional, reason="the training-data operators are not here")
def test_a_broken_import_is_raised(tmp_path):
    top = copy_of_the_repository(tmp_path)
    with open(top / "shardloom" / "llm" / "queries.py", "a") as f:
        f.write("\nfrom .common import no_such_name\n")
    out = names_of(top)
    assert out.returncode and "no_such_name" in out.stderr
    with open(top / "shardloom" / "llm" / "oracles.py", "a") as f:
        f.write("\nimport shardloom.no_such_module\n")
    assert names_of(top).returncode
