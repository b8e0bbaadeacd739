"""Columns that clash in case alone, and a vocabulary beyond 16 bits."""

import json
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldsmith.llm import rans, simhash
from foldsmith.llm._text import set_aside, unused
from foldsmith.session import scratch_path


def test_names_are_compared_as_spark_does(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Score int, score_IN int, other int")
    assert set_aside(df, "score", "ids").columns == ["Score_in_in", "score_IN", "other"]
    assert unused(df, "sCORE") == "sCORE_"


def test_stages_keep_columns_that_clash_in_case(spark, odd):
    docs = odd.withColumns({"_ROW": F.lit("mine"), "IDS": F.lit("theirs"), "N_Tokens": F.lit(7)})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {(r._ROW, r.IDS, r.N_Tokens) for r in kept.collect()} == {("mine", "theirs", 7)}
    out = corpus_pipeline.encode(spark, docs, "")
    assert out.count() == docs.count() and out.where("round_trip").count() > 60


def test_a_vocabulary_beyond_16_bits(spark, tmp_path):
    model = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    vocab = model["model"]["vocab"]
    vocab |= {f"unused entry {i}": len(vocab) + i for i in range(70_000 - len(vocab))}
    path = tmp_path / "large.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    texts = ["two short texts", None, "of few ids"]
    out = scratch_path(spark, "wide")
    rans.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out, str(path))
    tok = Tokenizer.from_file(str(path))
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = rans.read_tokens(spark, out).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, np.uint32).tolist() for r in got] == want
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
