"""The chunk table against the library on whole texts."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from fleetlens.llm import sentencepiece_codec as C
from fleetlens.llm.queries import tokenizer_model

MODEL = tokenizer_model()
SP = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, ids string, decoded int"


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    coded = C.encode(df, MODEL, **options)
    got = {r.doc_id: r for r in coded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = SP.encode(t or "", add_eos=True)
        assert got[i].ids == ids, t
        assert got[i].decoded == SP.decode(ids), t
    again = {r.doc_id: r.decoded for r in C.decode(coded, MODEL).collect()}
    assert again == {i: r.decoded for i, r in got.items()}


def test_random_texts_equal_the_library(spark):
    rnd = random.Random(1)
    alphabet = list("abcde theé\n\t ñß▁  　中🎉\x00\x01</s>��") + ["the ", " and", "  ", "​", "<unk>", "힣"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    check(spark, texts, max_chunks=50, max_bytes=300)


def test_edges(spark):
    check(spark, [None, "", " ", "   ", "▁", "a", " a ", "a  ", "\n", "word " * 60_000, "x" * 5_000, " " * 3_000, "same", "same"])
    assert C.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_real_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(spark, texts)


def test_models_that_cross_markers_are_refused():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.pieces.add(piece="of▁the", score=0)
    with pytest.raises(ValueError, match="cross"):
        C.check_model(proto.SerializeToString())


def test_no_end_id(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    assert C.encode(df, MODEL, end_id=False).first().ids == SP.encode("ab cd")
