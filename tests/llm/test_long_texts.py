"""One text of some megabytes beside short ones: whole results, linear time, bounded memory of the worker."""

import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldsmith.llm import pieces, rans, repetition

SIZE = 6_000_000


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioustrnlmdé") for _ in range(rnd.randint(1, 11))) for _ in range(30_000)]
    words = rnd.choices(vocab, k=SIZE // 7)
    for i in range(0, len(words), 900):
        words[i] += rnd.choice([".", ",\n", "\n\n", " "])
    words[500_000:500_120] = words[100:220]
    return " ".join(words)


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, "a b c"), (2, long_text), (3, None), (4, "the cat " * 40)], "doc_id long, text string")


def test_repetition(docs, long_text):
    words = long_text.encode().split()
    began = time.time()
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}[2]
    seen = Counter(zip(*(words[i:] for i in range(5))))
    covered = {i + j for i, w in enumerate(zip(*(words[i:] for i in range(5)))) if seen[w] > 1 for j in range(5)}
    assert (got.n_words, got.n_repeat_words, got.longest_repeat, got.kept) == (len(words), len(covered), 120, False)
    assert time.time() - began < 120


def test_repetition_of_nothing_but_repeats():
    """The scan that takes the place of the levels in a text of repeats, and the memory it takes."""
    text = b"one two three four five six seven " * 60_000
    tracemalloc.start()
    n, _, _, _, covered, longest = (int(x[0]) for x in repetition._stats([text], 5))
    assert (n, covered, longest) == (420_000, 420_000, 420_000 - 7)
    ids, sizes = repetition._word_ids([text[:300_000]])
    doc = np.zeros(len(ids), np.int32)
    a, b = (repetition.repeat_spans(ids, doc, 5, scan=s) for s in (0, 1 << 30))
    assert dict(zip(*(x.tolist() for x in a))) == dict(zip(*(x.tolist() for x in b)))
    assert tracemalloc.get_traced_memory()[1] < 120 * len(text)
    tracemalloc.stop()


def test_scan_equals_levels():
    rnd = np.random.default_rng(4)
    for k in range(60):
        ids = rnd.integers(0, rnd.integers(1, 5), int(rnd.integers(6, 300)))
        ids = np.tile(ids[: 1 + len(ids) // 6], 7)[: len(ids)] if k % 3 == 0 else ids
        doc = np.sort(rnd.integers(0, 3, len(ids)))
        a, b = (repetition.repeat_spans(ids, doc, 4, scan=s) for s in (0, 1 << 30))
        assert dict(zip(*(x.tolist() for x in a))) == dict(zip(*(x.tolist() for x in b)))


def test_token_file(docs, long_text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    start = 0
    for r in sorted(rans.token_digest(docs, path).collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode({1: "a b c", 2: long_text, 3: "", 4: "the cat " * 40}[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_blocks_of_very_different_length():
    """A block of a million ids beside short ones takes no more than its own width."""
    rnd = np.random.default_rng(2)
    blocks = [rnd.integers(0, 900, n).astype(np.uint32) for n in (1_000_000, 3, 70_000)]
    counts = np.bincount(np.concatenate(blocks), minlength=900)
    freq = rans.quantise(counts, 18)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    tracemalloc.start()
    coded = [rans.encode_blocks([b], freq, cum, 18)[0] for b in blocks]
    assert tracemalloc.get_traced_memory()[1] < 24 * 1_000_000
    tracemalloc.stop()
    assert coded == rans.encode_blocks(blocks, freq, cum, 18)
    assert all((a == b).all() for a, b in zip(rans.decode_blocks([(*c, len(b)) for c, b in zip(coded, blocks)], freq, cum, slots, 18), blocks))


def test_a_vocabulary_of_another_pre_tokenizer(tmp_path):
    """Without the pre-tokenizer that cuts before spaces, texts are encoded whole."""
    import json

    own = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    own["pre_tokenizer"]["use_regex"] = False
    path = str(tmp_path / "t.json")
    json.dump(own, open(path, "w"))
    tok, enc = Tokenizer.from_file(path), rans.WordEncoder(path, 2)
    assert rans.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2).by_pieces
    texts = ["of the people, by the people", "", "in the  end\n\nit is", "x" * 40]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    ids, sizes = enc.encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_pieces(docs, long_text):
    model = public_tokenizers.path("piece_bpe_32k.model")
    began = time.time()
    got = {r.doc_id: r for r in pieces.digest(docs, model).collect()}
    assert all(r.round_trip for r in got.values()) and time.time() - began < 240
    voc = pieces.Vocabulary(model)
    assert got[2].score == voc.segment(voc.normalise(long_text))[0]
