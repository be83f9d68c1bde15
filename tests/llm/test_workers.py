"""Queries whose Python workers can't import the package: what they need is sent with the code."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from auditlake.session import local_session
spark = local_session(cores="4", partitions=4, memory="3g")
def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("auditlake") is not None] * batch.num_rows)], ["found"])
assert not spark.range(1).mapInArrow(importable, "found boolean").first()["found"]
from auditlake.llm import queries
from auditlake.llm.tree_bpe import encode_documents
long = spark.createDataFrame([(1, "so many words, " * 6000), (2, "few")], "doc_id long, text string")
assert [r["n_tokens"] for r in encode_documents(long, queries.tokenizer("word_bpe_49k.json")).orderBy("doc_id").collect()] == [24000, 1]
for name, build in queries.BUILDS.items():
    build(spark, {FOLDER!r}).write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the smallest tables")
def test_workers_without_the_package(tmp_path):
    from auditlake.llm.queries import BUILDS

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout[-800:] + done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")] == list(BUILDS)
