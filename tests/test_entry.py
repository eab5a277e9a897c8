"""The entry keeps its lending queries whatever the document operators need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
for name in {absent!r}:
    sys.modules[name] = None            # an import of it fails
import warnings
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
    names, sql = set(e.queries()), set(e.oracle_sql())
from loanlens.plans import catalog
assert set(catalog.QUERIES) <= names and set(catalog.ORACLE) <= sql, "lending queries lost"
print(sorted(n for n in names if n.startswith("op") and n[2].isdigit()) != [], "pipeline" in names,
      any("left out" in str(w.message) for w in said))
"""


def run(absent):
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, absent=absent)], capture_output=True, text=True,
                         timeout=120, cwd=ROOT)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_lending_queries_do_not_need_the_document_operators():
    assert run(["loanlens.llm"]) == ["False", "False", "True"]
    assert run(["public_tokenizers"]) == ["False", "False", "True"]


def test_operators_do_not_need_the_pipeline():
    operators, pipeline, reported = run(["corpus_pipeline"])
    assert (pipeline, reported) == ("False", "True") or operators == "False"     # no document operators here
