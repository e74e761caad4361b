"""A digest index that outlives the session that made it."""

import json
import os
import subprocess
import sys

SESSION = """
import json, sys
from pyspark.sql import SparkSession
from geoledger.llm.exact_dedup import DigestIndex, add_batch
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.sql.warehouse.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
index = DigestIndex(spark, "Lasting_Index")
known = index.exists()
rows = [tuple(r) for r in json.loads(sys.argv[2])]
got = add_batch(spark.createDataFrame(rows, "doc_id bigint, text string"), index, batch=sys.argv[3]).collect()
print("GOT", json.dumps([known, index.buckets, sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)]))
"""


def session(warehouse, rows, batch):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-c", SESSION, warehouse, json.dumps(rows), batch], env=env, capture_output=True, text=True, timeout=240)
    found = [x for x in out.stdout.splitlines() if x.startswith("GOT ")]
    assert found, out.stderr[-2000:]
    return json.loads(found[0][4:])


def test_a_second_session_finds_the_index(tmp_path):
    warehouse = str(tmp_path / "warehouse")
    assert session(warehouse, [(1, "a b"), (2, "ab"), (3, "c")], "one") == [False, 3, [[1, 1, 2, True], [2, 1, 2, False], [3, 3, 1, True]]]
    assert session(warehouse, [(4, "a  b"), (5, "d")], "two") == [True, 3, [[4, 1, 3, False], [5, 5, 1, True]]]
    assert session(warehouse, [(4, "a  b"), (5, "d")], "two") == [True, 3, [[4, 1, 3, False], [5, 5, 1, True]]]  # a rerun
