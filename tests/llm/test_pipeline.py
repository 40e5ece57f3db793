"""The pipeline's decisions, stage by stage, against plain Python."""

import hashlib

from test_decontaminate import brute as contaminated
from test_neardup import brute as components
from test_secrets import base
from test_sentencepiece import SP

import corpus_pipeline as P
from fleetlens.llm import quality_gbt

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark", "secrets", "encode"]
    stage = dict(P.STAGES)

    one = stage["quality"](spark, docs, SF).cache()
    model = quality_gbt.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_gbt.score(docs, model).where("score >= 0.3").collect()}
    assert one.columns == docs.columns and rows_of(one) == [r for r in rows_of(docs) if r[0] in good]
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(clean - good) <= 0.02 * len(clean)

    two = stage["near_duplicates"](spark, one, SF).cache()
    first = {i for i, _, c in components([(r.doc_id, r.text) for r in one.collect()]) if i == c}
    assert two.columns == docs.columns and rows_of(two) == [r for r in rows_of(one) if r[0] in first] and two.count() < one.count()

    three = stage["benchmark"](spark, two, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = [(r.doc_id, r.text) for r in two.collect() if len(r.text or "") < 4000]
    found = {i for i, _ in contaminated(some, items)}
    left = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and {i for i, _ in some} - left == found

    four = stage["secrets"](spark, three, SF).cache()
    before = {r.doc_id: r for r in three.collect()}
    assert four.columns == docs.columns and four.count() == three.count()
    for r in four.collect():
        old = before[r.doc_id]
        assert not base(r.text) and r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
        assert r.text == old.text or base(old.text)

    last = {r.doc_id: r for r in stage["encode"](spark, four, SF).collect()}
    for r in four.collect():
        ids = SP.encode(r.text, add_eos=True)
        assert last[r.doc_id].n_tokens == len(ids)
        assert last[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert last[r.doc_id].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()

    assert {tuple(r) for r in P.run(spark, SF).collect()} == {tuple(r) for r in last.values()}


def test_empty_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (2, None, None, "s", None), (3, "word", "xx", "s", 4)]
    for part in ([], rows):
        frame = spark.createDataFrame(part, docs.schema)
        for name, stage in P.STAGES:
            out = str(tmp_path / f"{name}{len(part)}")
            stage(spark, frame, SF).write.parquet(out)
            frame = spark.read.parquet(out)
        assert (frame.count() > 0) == bool(part)
