import random

import numpy as np
import public_tokenizers
import pytest

from foldsmith.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def voc():
    return pieces.Vocabulary(PATH)


def texts(n, seed):
    rnd = random.Random(seed)
    alphabet = ["the", "ing", " ", " ", "\n", "é", "漢", "x", "▁", "\t", "  ", "<0x41>", "</s>", "ation", "🙂", "a" * 20]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(n)] + ["", " ", "▁", " ▁a", "a▁", "\x00"]


def test_round_trip(voc):
    for t in texts(300, 1):
        assert voc.decode(voc.segment(voc.normalise(t))[1]) == t


def test_score_is_that_of_an_exhaustive_viterbi(voc):
    for t in texts(60, 2):
        s = voc.normalise(t)
        best = [0.0] + [pieces.NONE] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = max([best[i] + voc.ids[s[i:j]][0] for i in range(j) if s[i:j] in voc.ids] + [best[j - 1] + pieces.BYTES_SCORE])
        assert voc.segment(s)[0] == best[-1]


def test_same_as_the_library_with_a_unigram_model(voc):
    """The library's own Viterbi over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < pieces.LEAST_SCORE:
            p.score = pieces.LEAST_SCORE if p.piece == pieces.START else -1e9
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    rnd = random.Random(5)
    for _ in range(200):
        t = " ".join("".join(rnd.choice("abcdeghinorstuéß") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 12)))
        mine = voc.segment(voc.normalise(t))
        theirs = sp.encode(t)
        total = sum(max(sp.get_score(i), pieces.LEAST_SCORE) for i in theirs)
        assert mine[0] == total


def test_chunks_combine_to_the_whole(voc):
    rnd = random.Random(3)
    for k in range(12):
        unit = ["the", "ing", "é", "tion", "qu", "漢"] + [" "] * (k % 3)  # some without any space
        s = voc.normalise("".join(rnd.choice(unit) for _ in range(rnd.randint(120, 300))))
        c = 40
        n = len(s) // c
        bounds = [i * c for i in range(n)] + [len(s)]
        mats = np.stack([voc.matrix(s[a : b + voc.longest - 1], b - a) for a, b in zip(bounds, bounds[1:])])
        states = pieces.cut_states(mats)
        got = [voc.segment(s[a + x : b + y]) for a, b, x, y in zip(bounds, bounds[1:], states, states[1:])]
        want = voc.segment(s)
        assert sum(x for x, _ in got) == want[0] == pieces.prefix_products(mats)[-1][0, 0]
        assert voc.decode([i for _, ids in got for i in ids]) == voc.decode(want[1])


def test_documents(spark, odd, empty):
    whole = {(r.doc_id, r.n_tokens, r.score) for r in pieces.digest(odd, PATH).collect()}
    rows = pieces.digest(odd, PATH, chunk=64).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    assert {(r.doc_id, r.score) for r in rows} == {(a, c) for a, _, c in whole}
    full = pieces.encode(odd, PATH, chunk=64)
    assert {"lang", "source", "n_chars", "fp", "n_tokens", "score", "ids"} <= set(full.columns)
    assert pieces.digest(empty, PATH).collect() == []


def test_columns_with_the_names_of_new_ones_are_kept(spark):
    rows = [(i, t, f"s{i}", f"r{i}", i * 7, f"i{i}", f"d{i}") for i, t in enumerate(["the cat", None, "", "a longer text of several words " * 9, "the cat"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, _row string, n_tokens int, ids string, decoded string")
    for chunk in (pieces.CHUNK, 64):
        out = pieces.decode(pieces.encode(df, PATH, chunk=chunk), PATH)
        got = out.select("doc_id", "text", "score_in", "_row", "n_tokens_in", "ids_in", "decoded_in").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
        assert all(r.decoded == (r.text or "") and len(r.ids) == 4 * r.n_tokens for r in out.collect())


def test_runs_of_spaces_take_the_pieces_of_runs(voc):
    """Indented and aligned texts, with one floor score for the lone word start and its runs, as the library's unigram mode scores them."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in ("x    return y", "a   b", "  x", "a     b"):
        blank = [sum(not own.id_to_piece(i).strip(pieces.START) for i in ids) for ids in (voc.segment(voc.normalise(t))[1], own.encode(t))]
        assert blank == [1, 1]  # one piece for the run, not one for each space
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, pieces.LEAST_SCORE)
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    rnd = random.Random(7)
    for _ in range(200):
        t = "".join("".join(rnd.choice("abcdeghinorstu") for _ in range(rnd.randint(1, 9))) + " " * rnd.choice((1, 2, 3, 4, 8, 16, 17, 40)) for _ in range(rnd.randint(1, 12)))
        t = " " * rnd.randrange(20) + t + "x"
        mine, theirs = voc.segment(voc.normalise(t)), sp.encode(t)
        assert mine[0] == sum(max(own.get_score(i), pieces.LEAST_SCORE) for i in theirs)
        assert voc.decode(mine[1]) == t


def test_chunks_cut_inside_runs_combine_to_the_whole(voc):
    rnd = random.Random(8)
    for _ in range(12):
        s = voc.normalise("".join(rnd.choice(["the", "ing", "x", "\n", " ", " " * 7, " " * 30]) for _ in range(60)) + "the" * 40)
        n = len(s) // 40
        bounds = [i * 40 for i in range(n)] + [len(s)]
        mats = np.stack([voc.matrix(s[a : b + voc.longest - 1], b - a) for a, b in zip(bounds, bounds[1:])])
        states = pieces.cut_states(mats)
        got = [voc.segment(s[a + x : b + y]) for a, b, x, y in zip(bounds, bounds[1:], states, states[1:])]
        want = voc.segment(s)
        assert sum(x for x, _ in got) == want[0] == pieces.prefix_products(mats)[-1][0, 0]
        assert voc.decode([i for _, ids in got for i in ids]) == voc.decode(want[1])
