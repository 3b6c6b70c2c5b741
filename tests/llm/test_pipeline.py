"""Each stage of the pipeline on what the one before kept, against brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest import texts
from test_lines import plain
from test_models import labelled
from test_near_duplicates import classes
from test_repeats import cover
from test_tokens import PATH, check_packing

import corpus_pipeline
from wordloom.llm import bpe


def cut(rows, length=200):
    seen = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        for a in range(len(b) - length + 1):
            seen[b[a : a + length]] = seen.get(b[a : a + length], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = cover(len(b), [a for a in range(len(b) - length + 1) if seen[b[a : a + length]] > 1], length)
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    odd = [(5000 + i, t, "en", "s", len(t or "")) for i, t in texts() if i is not None]
    docs, labels = labelled(spark)
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    rows = [(r.doc_id, r.text, "en", "s", len(r.text)) for r in docs.collect()] + odd
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            left = {r.doc_id for r in now.collect()}
            assert left == set(kept) - toxic
            kept = {i: t for i, t in kept.items() if i in left}
        elif name == "line_dedup":
            kept = {i: t for i, _, _, t in plain(list(kept.items()))}
        elif name == "near_dedup":
            of = classes(sorted(kept.items()))
            kept = {i: t for i, t in kept.items() if of[i] == i}
        elif name == "suffix_array_dedup":
            kept = cut(kept.items())
        if name != "packing":
            assert tuple(now.columns) == corpus_pipeline.COLUMNS
            assert {r.doc_id: r.text or "" for r in now.collect()} == {i: t or "" for i, t in kept.items()}
    check_packing(now.collect(), kept, bpe.library(PATH), 2048)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
