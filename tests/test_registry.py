import subprocess
import sys
from pathlib import Path


def test_entry_is_importable_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["chat_id", "entity_id", "type", "state", "reason", "episodes", "appear"] and df.count() > 0
