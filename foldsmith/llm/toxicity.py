"""Toxic spans by a linear-chain CRF; documents are scored from its forward-backward marginals.

Labels exist for documents only, so words are labelled first: a word of a toxic document is toxic if the word,
or its first five bytes, keeps to toxic documents (Dunning's log-likelihood ratio and a ratio of
frequencies). The CRF learns these labels from affixes, n-grams and neighbours and so also finds forms
never labelled. A logistic function of a document's greatest marginal and of their sum, fitted to the
documents' labels, gives the score.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm import crf
from foldsmith.llm._sample import bounded_sample
from foldsmith.llm._text import binary_text, record, text_slices
from foldsmith.session import materialize

#: Toxic and clean documents to learn from at most; runs of words with a toxic word, and of those without one, that the CRF is trained on at most.
TOXIC_SAMPLE, CLEAN_SAMPLE, TOXIC_RUNS, CLEAN_RUNS = 1500, 4500, 3000, 1500
LEAST_RATIO, LEAST_LLR = 8.0, 25.0
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def forms_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of five bytes with a * after them."""
    return words | {w[:5] + b"*" for w in words if len(w) > 5}


def toxic_forms(rows: DataFrame) -> set[bytes]:
    """Forms of the words of (y, text) rows that keep to toxic documents; counted in documents."""
    schema = pa.schema([("form", pa.binary()), ("y", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for piece, texts in text_slices(batches):
            n: dict = {}
            for y, t in zip(piece.column(0).to_pylist(), texts):
                for form in forms_of(set(t.lower().split())):
                    n[form, y] = n.get((form, y), 0) + 1
            if n:
                yield record(schema, [f for f, _ in n], [y for _, y in n], list(n.values()))

    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m1, m0 = total[1], total[0]
    counts = rows.mapInArrow(run, "form binary, y long, n long").groupBy("form").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (1, 0)))
    p = (F.col("n1") + F.col("n0")) / (m1 + m0)
    term = lambda n, m: F.when(n > 0, n * F.log(n / (m * p))).otherwise(0.0) + F.when(n < m, (m - n) * F.log((m - n) / (m * (1 - p)))).otherwise(0.0)
    llr = 2 * (term(F.col("n1"), F.lit(m1)) + term(F.col("n0"), F.lit(m0)))
    ratio = (F.col("n1") + 0.5) / (m1 + 1) / ((F.col("n0") + 0.5) / (m0 + 1))
    # Each has such a ratio in a sample of bounded size, so few forms come to the driver.
    return {bytes(r.form) for r in counts.where((ratio >= LEAST_RATIO) & (llr >= LEAST_LLR)).select("form").collect()}


def is_toxic(word: bytes, forms: set[bytes]) -> bool:
    return word in forms or len(word) > 5 and word[:5] + b"*" in forms


def sampled_runs(rows: DataFrame, forms: set[bytes], toxic: int = TOXIC_RUNS, clean: int = CLEAN_RUNS) -> list[tuple[list[bytes], np.ndarray]]:
    """(words, labels) of runs of the (y, text) rows: some with a toxic word and some without, drawn by the hash of their words."""
    schema = pa.schema([("hot", pa.bool_()), ("order", pa.int64()), ("words", pa.binary()), ("marks", pa.binary())])

    def run(batches):
        for piece, texts in text_slices(batches):
            out = []
            for y, t in zip(piece.column(0).to_pylist(), texts):
                words = t.lower().split()
                marks = np.array([y == 1 and is_toxic(w, forms) for w in words], np.int8)
                for some, own in crf.runs(words, marks):
                    line = b" ".join(some)
                    out.append((bool(own.any()), xxhash.xxh64_intdigest(line) >> 1, line, own.tobytes()))
            if out:
                yield record(schema, *zip(*out))

    found = materialize(rows.mapInArrow(run, "hot boolean, order long, words binary, marks binary"), "toxic-runs")
    out = []
    for hot, limit in ((True, toxic), (False, clean)):
        some = found.where(F.col("hot") == hot).orderBy("order", "words", "marks").limit(limit)
        out += [(bytes(r.words).split(), np.frombuffer(bytes(r.marks), np.int8).astype(np.int64)) for r in some.collect()]
    return out


class ToxicModel:
    """The CRF and the logistic weights (bias, greatest marginal, log of 1 + their sum)."""

    def __init__(self, model: crf.Model, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights @ np.stack([np.ones(len(top)), top, np.log1p(total)]))))


def document_marginals(doc: np.ndarray, prob: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest toxic marginal, sum of those of 0.1 or more) of each document."""
    top = np.zeros(n)
    np.maximum.at(top, doc, prob[:, 1])
    return top, np.bincount(doc, np.where(prob[:, 1] >= 0.1, prob[:, 1], 0), n)


def train_model(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel | None:
    """A model from rows (key, text, label 0/1); None unless both labels occur.

    labelled is a bounded sample such as sampled_rows gives; no more than twice TOXIC_SAMPLE + CLEAN_SAMPLE rows are used (a
    documented bound, met by repeated ids alone). Their texts stay in the tasks: forms are counted and documents are
    scored there, and TOXIC_RUNS + CLEAN_RUNS runs of words reach the driver. A null text counts as empty.
    """
    some = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).cast("string").alias("k"), F.col(label).cast("long").alias("y"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = materialize(bounded_sample(some, ["k", "y", "text"], 2 * (TOXIC_SAMPLE + CLEAN_SAMPLE)).select("y", "text"), "toxic-rows")
    if rows.select("y").distinct().count() < 2:
        return None
    model = crf.train(sampled_runs(rows, toxic_forms(rows)), [0, 1], epochs=3)
    sent, name = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = pa.schema([("y", pa.int64()), ("top", pa.float64()), ("total", pa.float64())])

    def run(batches):
        for piece, texts in text_slices(batches):
            doc, _, prob = crf.tagger(name, sent.value).tag([t.lower().split() for t in texts])
            yield record(schema, piece.column(0), *document_marginals(doc, prob, len(texts)))

    found = np.array(sorted((r.y, r.top, r.total) for r in rows.mapInArrow(run, "y long, top double, total double").collect()))
    y, top, total = found.T
    x = np.stack([np.ones(len(y)), top, np.log1p(total)])
    w, keep = np.zeros(3), np.diag([0.0, 1e-2, 1e-2]) * len(y)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-(w @ x)))
        w += np.linalg.solve((x * (p * (1 - p))) @ x.T + keep * 1e-2 + 1e-6 * np.eye(3), x @ (y - p) - keep @ w * 1e-2)
    return ToxicModel(model, w)


def score_documents(docs: DataFrame, model: ToxicModel | None, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, score, predicted[, spans]) for every row; spans: offsets [start, end) in characters of words with a marginal of 0.5 or more.

    Only the text enters. Null and empty texts score as texts without a toxic word; without a model
    every score is 0. Repeated rows and null ids keep a row each, other columns are left out, an empty table gives no rows. One pass, no shuffle.
    """
    ddl = f"`{doc_id}` long, score double, predicted int" + ", spans array<struct<start:int,end:int>>" * spans
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        model = sent.value
        for piece, texts in text_slices(batches):
            score, found = np.zeros(len(texts)), [[] for _ in texts]
            if model:
                doc, place, prob = crf.tagger(name, model.model).tag([t.lower().split() for t in texts])
                score = model.score(*document_marginals(doc, prob, len(texts)))
                hot = np.flatnonzero(prob[:, 1] >= 0.5)
                for d in np.unique(doc[hot]).tolist() if spans else []:
                    own = set(place[hot[doc[hot] == d]].tolist())
                    found[d] = [{"start": m.start(), "end": m.end()} for i, m in enumerate(WORD.finditer(texts[d].decode("utf-8", "replace"))) if i in own]
            cols = [piece.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(found, span_type)] * spans, [doc_id, "score", "predicted"] + ["spans"] * spans)

    return binary_text(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, text).mapInArrow(run, ddl)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled documents that may teach.

    Of several labels of a document the greatest counts. The ids are sampled before the texts are joined, so
    the join's small side has TOXIC_SAMPLE + CLEAN_SAMPLE rows at most.
    """
    own = labels.where(~held_out(doc_id) & F.col("toxic").isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias(doc_id)).agg(F.max("toxic").alias("toxic"))
    some = [bounded_sample(own.where(F.col("toxic") == y), [doc_id], n) for y, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).join(F.broadcast(some[0].union(some[1])), doc_id)
