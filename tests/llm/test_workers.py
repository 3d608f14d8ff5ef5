"""Tasks run where the package cannot be imported."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from digestry.session import local_session
spark = local_session("2", 2)

def found(batches):
    import importlib.util
    for b in batches:
        yield b.assign(i=int(importlib.util.find_spec("digestry") is not None))

assert spark.range(2).toDF("i").mapInPandas(found, "i long").agg(F.max("i")).first()[0] == 0
from digestry.llm import align, line_dedup, lm, media, merkle, minhash, packing, quality, rules, urls
docs = spark.createDataFrame([(i, f"words of text {{i}} " * 12, "en", "s", 3) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
pages = docs.select(F.concat(F.lit("http://x.org/"), "doc_id").alias("url"))
from digestry import Settings
from digestry.operators import vectors
rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
for out in (align.align_tokens(docs), line_dedup.dedup_lines(docs), lm.score(docs, F.col("doc_id") < 3), media.from_png(media.to_png(docs.select("doc_id", "text")).drop("text")),
            merkle.verify(docs), minhash.near_duplicates(docs), packing.pack(docs), quality.classify(docs, labels), rules.apply_rules(docs),
            urls.filter_urls(pages, [urls.Rule("org/", "allow")]), vectors.drop_close(rows, Settings())):
    assert out.count() > 0
print("all ran")
"""


def test_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": "/opt/tokenizers"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    assert "all ran" in run.stdout, run.stderr[-3000:]
