"""The pipeline's stages against what each may do to its own input, and the guard of the entry point."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from florilege.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = {name: [{r.doc_id for r in df.select("doc_id").collect()} for df in pair] for name, pair in seen.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ids["quality"]
    assert sum(labels.get(i) == 0 for i in after) <= 0.1 * sum(labels.get(i) == 0 for i in before)
    assert sum(labels.get(i) == 1 for i in after) >= 0.97 * sum(labels.get(i) == 1 for i in before)
    leaks = {r.doc_id for r in queries.QUERIES["op2_decontamination"](spark, SF).collect()}
    assert ids["decontamination"][1] == ids["decontamination"][0] - leaks
    assert ids["secrets"][0] == ids["secrets"][1] == ids["packing"][1]
    assert seen["secrets"][1].where(F.col("text").rlike("token = .[0-9a-f]{32}")).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns[:2] == ["doc_id", "piece"]


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, rows without an id, repeated ids and clashing columns, through all stages."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    good = given.where("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(20)
    no_id = F.lit(None).cast("long")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).select(F.concat(F.lit(good.first().text), F.lit(" "), "text").alias("text"))
    leak = leak.select(no_id.alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.length("text").cast("long").alias("n_chars"))
    odd = good.union(good.limit(5)).union(good.limit(5).withColumn("doc_id", no_id)).union(leak).unionByName(spark.createDataFrame([(900, None, None, None, None), (901, "", None, None, 0)], given.schema))
    odd = odd.withColumns({c: F.lit("clash") for c in ("_row", "score", "spans", "_leak", "_kept", "fp", "piece")})
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    whole = {r.doc_id for r in good.collect()}
    kept = [r.doc_id for r in out if r.piece == 0]
    # copies without an id fall to the rows with one, the leak without an id is dropped, ids are there once
    assert set(kept) <= whole | {900, 901} and len(kept) == len(set(kept)) and len(whole & set(kept)) >= 15
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rest_stands_without_these_folders():
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, sys.argv[1])\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith(('florilege.llm', 'corpus_pipeline')) else real(n, *a)\nimport __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op1')]; print('fine')"
    done = subprocess.run([sys.executable, "-c", code, str(root)], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr
