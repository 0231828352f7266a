"""The archive for executors."""

import subprocess
import sys

from quern.ship import archive, ship


def test_archive_imports_by_itself(tmp_path):
    path = archive(tmp_path / "quern.zip")
    code = f"import sys; sys.path.insert(0, {str(path)!r}); import quern.plans.engine as e; assert {str(path)!r} in e.__file__"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_ship(spark):
    ship(spark)
    found = spark.range(4).repartition(2).mapInPandas(lambda parts: (p.assign(n=__import__("quern.ship").__name__) for p in parts), "id long, n string").collect()
    assert {r.n for r in found} == {"quern"}
