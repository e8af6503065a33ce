"""The shared folder and written tables."""

import os
import subprocess
import sys

from quillmill.session import materialize, scratch_path, spread


def test_the_named_folder_is_used(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(named + "/x-") and first != second
    written = materialize(spark.range(5), "five")
    assert written.count() == 5 and named in written.inputFiles()[0]


def test_written_tables_may_be_empty(spark):
    assert materialize(spark.range(0), "none").count() == 0


def test_only_small_inputs_are_dealt_out(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 4
    wide = spark.range(0, 10, 1, 9)
    assert spread(wide) is wide


def test_a_local_session_without_a_folder_gets_one():
    """In a process of its own, since a session keeps its settings."""
    code = (
        "from quillmill.session import local_session, materialize, scratch_path\n"
        "spark = local_session(1)\n"
        "assert materialize(spark.range(3), 'x').count() == 3\n"
        "a, b = scratch_path(spark, 'a'), scratch_path(spark, 'b')\n"
        "assert a.rsplit('/', 1)[0] == b.rsplit('/', 1)[0]\n"
    )
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, capture_output=True)
