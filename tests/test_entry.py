"""The entry lists the library's queries, with the subpackage llm and without it."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
HIDDEN = """
import sys
hidden = sys.argv[1].split(",")
class Hide:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in hidden):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(*e.queries()); print(*e.oracle_sql())
"""


def listed(hidden):
    said = subprocess.run([sys.executable, "-B", "-c", HIDDEN, hidden], cwd=HERE, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return [set(line.split()) for line in said.stdout.splitlines()]


def test_entry_without_llm():
    queries, sql = listed("gleanery.llm,corpus_pipeline")
    assert "slice_topk_evidence" in queries and sql <= queries
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in queries)
    # the pipeline's file alone brings nothing
    assert listed("gleanery.llm")[0] == queries
