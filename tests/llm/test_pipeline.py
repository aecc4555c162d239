"""The pipeline against a step-by-step version on whole small tables."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tapeloom.llm import pii, quality
from tests.llm.test_copies import alike, five, groups
from tests.llm.test_texts import overlaps

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    sets = {i: five(t) for i, t in left.items()}
    same = groups(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    left = {i: t for i, t in left.items() if same[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: pii.masked(t) for i, t in left.items() if not any(overlaps(t, x) for x in items if set(x.lower().split()[:8]) & set(t.lower().split()))}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(left)
    for i, t in left.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[r.start: r.start + r.length].tobytes()) for r in own.itertuples()]


def test_stages_take_odd_rows_and_keep_columns(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, fp string"
    docs = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 0.5, 1, "x"), (None, "mail a@b.cd", "en", "s", 11, 0.5, 1, "x"), (2, "", "en", "s", 0, 0.5, 1, "x")], odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, SF)
            assert out.dtypes == df.dtypes, name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
