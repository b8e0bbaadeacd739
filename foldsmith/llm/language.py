"""Language identification by a linear-chain CRF that labels each word of code-switched text.

Trained on a bounded sample of runs of words from documents with known language; every word of such a document counts as
of that language. A document's language is the label with the greatest mean probability over its
words, the score that mean.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.llm import crf
from foldsmith.llm._text import binary_text, record, text_slices

#: Runs of words that the model is trained on: of all languages together about, and of each language at least (if it has them).
SAMPLE, LEAST = 4000, 100
NONE = "und"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lettered(text: bytes) -> list[bytes]:
    return [w for w in text.lower().split() if crf.has_letter(w)]


def sampled_runs(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(lang, order, words): a bounded sample of the runs of words of the rows with text and language.

    Every run of every text may be drawn, by the hash of its words, place and key, so the same ones at every run and
    partitioning; equal runs differ in nothing else. Each language has max(least, sample / languages) runs, or all of its own.
    """
    some = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("binary").alias("text"))
    about = F.sum(F.greatest(F.lit(1.0), F.octet_length("text") / 2048))  # runs of 256 words; most have fewer bytes
    sizes = {r.lang: r.n for r in some.groupBy("lang").agg(about.alias("n")).collect()}  # a row for each label of the model
    each = max(least, sample // max(1, len(sizes)))
    share = {x: min(1.0, 2 * each / n) for x, n in sizes.items()}
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for piece, texts in text_slices(batches, 2):
            out = []
            for x, k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts):
                for i, (words, _) in enumerate(crf.runs(_lettered(t))):
                    line = b" ".join(words)
                    order = xxhash.xxh64_intdigest(line + b"\0" + k.encode("utf-8", "replace"), i) >> 1
                    if order < share[x] * (1 << 63):
                        out.append((x, order, line))
            if out:
                yield record(schema, *zip(*out))

    found = binary_text(some, "lang", "key", "text").mapInArrow(run, "lang string, order long, words binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "words"))
    return found.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth")


def train_model(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, least: int = LEAST) -> crf.Model | None:
    """A model of all languages of the rows with text and language; None if none has a word with a letter.

    The sample (a documented bound) reaches the driver. Repeated rows are drawn like others, other columns are ignored.
    """
    rows = sorted((r.lang, r.order, bytes(r.words)) for r in sampled_runs(labelled, text, lang, key, sample, least).collect())
    labels = sorted({x for x, *_ in rows})
    number = {x: i for i, x in enumerate(labels)}
    docs = [(words.split(), number[x]) for x, _, words in rows]
    return crf.train([(w, np.full(len(w), y)) for w, y in docs], labels) if docs else None


def _judge(model: crf.Model | None, name: str, texts: list[bytes]):
    """(language, score of each text; text, place and label number of each word with a letter)."""
    pred, score = [NONE] * len(texts), np.zeros(len(texts))
    if not model:
        return pred, score, (np.empty(0, np.int64),) * 3
    doc, place, prob = crf.tagger(name, model, True).tag([t.lower().split() for t in texts])
    sums = np.stack([np.bincount(doc, prob[:, j], len(texts)) for j in range(prob.shape[1])], axis=1)
    n = np.bincount(doc, minlength=len(texts))
    pred = [model.labels[b] if c else NONE for b, c in zip(sums.argmax(axis=1), n)]
    return pred, np.clip(sums.max(axis=1) / np.maximum(n, 1), 0, 1), (doc, place, prob.argmax(axis=1))


def _spans(text: str, place: np.ndarray, label: np.ndarray, names: list) -> list[dict]:
    """Runs of words of one language, from the first character to the last; words without a letter neither begin nor end one."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    cut = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    return [{"start": words[place[a]][0], "end": words[place[b - 1]][1], "lang": names[label[a]]} for a, b in zip(cut, np.append(cut[1:], len(label)))]


def identify(docs: DataFrame, model: crf.Model | None, doc_id: str = "doc_id", text: str = "text", keep: tuple = (), spans: bool = False) -> DataFrame:
    """(doc_id, *keep, lang_pred, score[, spans]) for every row.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. spans: the parts of the text
    in one language, as [start, end) in characters and lang. Only the text enters. Repeated rows and null ids
    keep a row each; keep may not name the columns made here. One pass, no shuffle.
    """
    kept = [docs.schema[c] for c in keep]
    ddl = ", ".join([f"`{doc_id}` long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", *["spans array<struct<start:int,end:int,lang:string>>"] * spans])
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = sent.value
        for piece, texts in text_slices(batches, len(kept) + 1):
            pred, score, (doc, place, label) = _judge(model, name, texts)
            cols = [*piece.columns[:-1], pa.array(pred, pa.string()), pa.array(score)]
            if spans:
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                parts = [(slice(a, b), t) for a, b, t in zip(first, first[1:], texts)]
                cols.append(pa.array([_spans(t.decode("utf-8", "replace"), place[x], label[x], model.labels) if x.stop > x.start else [] for x, t in parts], span_type))
            yield pa.RecordBatch.from_arrays(cols, [doc_id, *keep, "lang_pred", "score", *["spans"] * spans])

    own = docs.select(F.col(doc_id).cast("long").alias(doc_id), *keep, F.col(text).alias("_text"))
    return own.select(*own.columns[:-1], F.col("_text").cast("binary")).mapInArrow(run, ddl)


def keep_languages(docs: DataFrame, model: crf.Model | None, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language identify() finds with a score of `least` or more.

    Rows without a letter go, null and empty texts among them; without a model all others stay. Repeated rows stay or go together,
    an empty table stays empty.
    """
    at = docs.columns.index(text)
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        model = sent.value
        for piece, texts in text_slices(batches, at):
            if model:
                pred, score, _ = _judge(model, name, texts)
                keep = (np.array(pred) != NONE) & (score >= least)
            else:
                keep = np.array([any(map(crf.has_letter, t.split())) for t in texts], bool)
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def learning_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that may teach: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(~held_out(doc_id))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
