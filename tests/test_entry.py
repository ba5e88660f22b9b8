import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_corpus_operators(tmp_path):
    """The rest imports and lists its queries if the corpus folder and the pipeline are gone."""
    for p in ("__spark_entry__.py", "sievelake"):
        subprocess.run(["cp", "-r", REPO / p, tmp_path], check=True)
    subprocess.run(["rm", "-r", tmp_path / "sievelake" / "llm"], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'classify_reads' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_queries_and_sql_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
