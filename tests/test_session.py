import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from uttmill.session import cut_lineage, local_session, scratch_path
spark = local_session(2, 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut_lineage(spark.range(10).where("id > 3")).count() == 6
path = scratch_path(spark, "t")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3
print("at", path)
"""


def test_a_session_without_settings_has_a_folder_that_goes(tmp_path):
    """An empty configuration, whatever this machine's defaults are."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=str(REPO))], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    made = [line for line in done.stdout.splitlines() if line.startswith("at ")]
    assert made and not Path(made[0][3:].removeprefix("file:")).exists()
