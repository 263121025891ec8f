import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from cohortlens.llm.registry import QUERIES
from cohortlens.session import local_session

spark = local_session("alone", cpus=4, shuffle_partitions=4, memory="4g")
spark.sparkContext.setCheckpointDir({folder!r})


def imported(_):
    try:
        import cohortlens
    except ModuleNotFoundError:
        return [False]
    return [True]


assert spark.sparkContext.parallelize([0], 1).mapPartitions(imported).collect() == [False]
for name, query in QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_executors_do_not_need_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("done") >= 13
