"""The entry point with and without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def names(hidden):
    code = f"import sys; sys.modules.update(dict.fromkeys({hidden!r})); import __spark_entry__ as e; print(*e.queries(), *('sql:' + n for n in e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_other_queries_stay_when_an_optional_package_is_absent():
    for hidden in (["ahocorasick"], ["geoweave.llm"], ["corpus_pipeline"]):
        found = names(hidden)
        assert len(found) > 300 and "j02_near" in found and not any(n.removeprefix("sql:").startswith("op") or n == "pipeline" for n in found)
    whole = names([])
    assert all(n.removeprefix("sql:") in whole for n in whole)
