import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree_on_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_other_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tidewright"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    for extra in tmp_path.glob("tidewright/llm"):
        subprocess.run(["rm", "-r", extra], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tidewright").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(?:from|import)\b.*\bllm\b", p.read_text()), p
