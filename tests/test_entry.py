import subprocess
import sys

import pytest


@pytest.mark.parametrize("missing", ["corvane.llm", "zstandard", "xxhash"])
def test_core_queries_survive_a_missing_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
