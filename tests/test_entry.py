"""The registry: names, SQL for known names, and a life without the optional parts."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 55


def test_registry_without_the_optional_parts(tmp_path):
    """Without the folders of training-data operators and the pipeline, the rest imports and keeps its queries."""
    code = (
        "import sys, importlib.util as u, importlib.machinery as m\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, p=None: None if n.startswith('millrace.llm') or n == 'corpus_pipeline' else real(n, p)\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'list_page' in names and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in names)\n"
        "assert not any(k.startswith('millrace.llm') for k in sys.modules)\n"
    )
    root = entry.__file__.rpartition("/")[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)
