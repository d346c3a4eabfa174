"""The entry module without what the corpus operators need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

HERE = str(Path(__file__).resolve().parents[1])
PROBE = """
import sys
sys.path.insert(0, {here!r})
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") and n[2:3].isdigit() for n in e.queries()), "pipeline" in e.queries())
"""


def probe(*hidden: str) -> list[str]:
    return subprocess.run([sys.executable, "-c", PROBE.format(here=HERE, hidden=hidden)], capture_output=True, text=True, check=True).stdout.split()


def test_the_library_proper_is_there_without_the_corpus_operators():
    bare = probe("tallyspark.llm", "corpus_pipeline")
    assert int(bare[0]) > 100 and int(bare[1]) > 100 and bare[2:] == ["False", "False"]
    assert probe("xxhash")[2:] == ["False", "False"]
