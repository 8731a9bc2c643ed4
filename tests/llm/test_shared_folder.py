"""Where intermediate tables go: never to a folder that only this machine has, unless all runs here."""

import os
import subprocess
import sys
import textwrap
from types import SimpleNamespace

import pytest

from weftgraph.llm import util

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(context_dir, conf, master):
    context = SimpleNamespace(getCheckpointDir=lambda: context_dir, master=master)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))


def test_settings():
    assert util.shared_folder(session("hdfs:///a/b/", {"spark.checkpoint.dir": "hdfs:///c"}, "yarn")) == "hdfs:///a/b"
    assert util.shared_folder(session(None, {"spark.checkpoint.dir": "hdfs:///c"}, "yarn")) == "hdfs:///c"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            util.shared_folder(session(None, {}, master))


@pytest.mark.parametrize("how", ["context", "nothing"])
def test_sessions(tmp_path, how):
    """One with only SparkContext.setCheckpointDir, one local session without any setting."""
    code = f"""
        from pyspark import SparkConf
        from pyspark.sql import SparkSession
        import pyspark.core.context
        conf = SparkConf().setMaster("local[1]").set("spark.ui.enabled", "false").set("spark.sql.warehouse.dir", "{tmp_path}/warehouse").set("spark.sql.shuffle.partitions", "2")
        spark = SparkSession.builder.config(conf=conf).getOrCreate()
        if "{how}" == "context":
            spark.sparkContext.setCheckpointDir("{tmp_path}/set")
        from weftgraph.llm import line_dedup, quality
        docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
        assert quality.judge(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), stratum_col=None).count() == 2
        assert line_dedup.drop_common_lines(docs).count() == 2
    """
    os.mkdir(f"{tmp_path}/conf")  # no defaults of the machine
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, check=True, timeout=200, env=os.environ | {"PYTHONPATH": REPO, "SPARK_CONF_DIR": f"{tmp_path}/conf"})
    assert set(os.listdir(tmp_path)) & {"set", "warehouse-checkpoints"} == {"set" if how == "context" else "warehouse-checkpoints"}
