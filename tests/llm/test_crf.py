import itertools
import random

import numpy as np

from foldsmith.llm import crf, language, toxicity


def test_marginals_against_enumeration():
    rnd = np.random.default_rng(3)
    sizes = np.array([1, 3, 0, 5])
    emit, trans = rnd.normal(size=(9, 3)), rnd.normal(size=(3, 3))
    got, pairs = crf.marginals(emit, trans, crf.chains(sizes, 5))
    want, want_pairs, at = np.zeros((9, 3)), np.zeros((3, 3)), 0
    for n in sizes:
        paths = list(itertools.product(range(3), repeat=n))
        score = np.array([sum(emit[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        prob = np.exp(score) / np.exp(score).sum()
        for p, x in zip(paths, prob):
            for i, y in enumerate(p):
                want[at + i, y] += x
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x
        at += n
    assert np.allclose(got, want, atol=1e-4) and np.allclose(pairs, want_pairs, atol=1e-4)


def test_messages_across_the_cuts_of_a_document():
    """Chains of 2 words of longer documents against whole documents."""
    rnd = np.random.default_rng(5)
    sizes = np.array([0, 7, 1, 2, 0, 5, 30])
    emit, trans = 2 * rnd.normal(size=(45, 4)), 2 * rnd.normal(size=(4, 4))
    want, want_pairs = crf.marginals(emit, trans, crf.chains(sizes, 30))
    for size in (1, 2, 4):
        got, pairs = crf.marginals(emit, trans, crf.chains(sizes, size), crf.chain_documents(sizes, size))
        assert np.allclose(got, want, atol=1e-4) and np.allclose(pairs, want_pairs, atol=1e-3)


def test_a_tagged_text_of_any_length_is_one_chain():
    """Words of a long text, labelled by emissions and transitions summed by hand, forward and backward in log space."""
    rnd = np.random.default_rng(6)
    words = [f"w{i % 90}".encode() for i in rnd.integers(0, 90, 3 * crf.CHAIN + 5)]
    model = crf.train([(words, rnd.integers(0, 3, len(words)))], ["x", "y", "z"], epochs=2)
    _, _, got = crf.Tagger(model).tag([words, [], words[:3]])
    emit, trans = model.emissions(words).astype(float), model.trans.astype(float)
    fwd, back = [emit[0]], [np.zeros(3)]
    for e in emit[1:]:
        fwd.append(np.logaddexp.reduce(fwd[-1][:, None] + trans, axis=0) + e)
    for e in emit[:0:-1]:
        back.append(np.logaddexp.reduce(trans + (e + back[-1])[None, :], axis=1))
    both = np.array(fwd) + np.array(back[::-1])
    want = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
    assert np.allclose(got[: len(words)], want, atol=1e-3)


def brute_tag(model, words):
    emit, trans = model.emissions(words).astype(float), model.trans.astype(float)
    paths = np.array(list(itertools.product(range(len(model.labels)), repeat=len(words))))
    score = emit[np.arange(len(words)), paths].sum(axis=1) + trans[paths[:, :-1], paths[:, 1:]].sum(axis=1)
    prob = np.exp(score - np.logaddexp.reduce(score))
    return np.array([[prob[paths[:, i] == y].sum() for y in range(len(model.labels))] for i in range(len(words))])


def short_rows(seed):
    rnd = random.Random(seed)
    return [(i, " ".join(speak(rnd, TONGUES[x], rnd.randint(1, 3)) for x in rnd.choices(list(TONGUES), k=rnd.randint(1, 2))) + rnd.choice(["", " 12", " !"]), rnd.choice(list(TONGUES))) for i in range(40)]


def test_language_query_against_enumeration(spark):
    """Languages and scores of short texts from all label sequences."""
    df = spark.createDataFrame(short_rows(7), "doc_id long, text string, lang string")
    model = language.train_model(df)
    for r in language.identify(df, model, keep=("text",), spans=True).collect():
        words = [w for w in r.text.lower().encode().split() if w.isalpha()]
        mean = brute_tag(model, words).mean(axis=0)
        assert abs(r.score - mean.max()) < 1e-4 and r.lang_pred == model.labels[mean.argmax()]
        best = brute_tag(model, words).argmax(axis=1)
        assert [s.lang for s in r.spans] == [model.labels[y] for y, _ in itertools.groupby(best)]
        assert " ".join(r.text[s.start : s.end] for s in r.spans).split()[: len(words)][0] == words[0].decode()
    assert {r.doc_id for r in language.keep_languages(df, model, 0.6).collect()} == {r.doc_id for r in language.identify(df, model).collect() if r.score >= 0.6}
    assert language.keep_languages(df.selectExpr("*", "1 AS score", "2 AS lang_pred"), model, 0.6).columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert language.keep_languages(df, None, 0.6).count() == 40


def test_toxicity_query_against_enumeration(spark):
    """Scores and spans of short texts from all label sequences and the logistic weights."""
    rnd = random.Random(8)
    rows = [(i, " ".join([*speak(rnd, TONGUES["aa"], rnd.randint(1, 6)).split(), *["zorka", "blurbo"][: rnd.randint(1, 2) * (i % 2)]]), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_model(df)
    text = {i: t for i, t, _ in rows}
    for r in toxicity.score_documents(df, model).collect():
        prob = brute_tag(model.model, text[r.doc_id].encode().split())[:, 1]
        x = np.array([1, prob.max(), np.log1p(prob[prob >= 0.1].sum())])
        assert abs(r.score - 1 / (1 + np.exp(-model.weights @ x))) < 1e-3 and r.predicted == (r.score >= 0.5)
        words = [(m.start(), m.end()) for m in toxicity.WORD.finditer(text[r.doc_id])]
        assert [(s.start, s.end) for s in r.spans] == [w for w, p in zip(words, prob) if p >= 0.5]


def test_every_language_is_learned(spark):
    """More labels than 64, and one of few rows beside one of many."""
    rnd = random.Random(9)
    stems = {f"l{i:02}": ["".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiouy") for _ in range(2)) for _ in range(4)] for i in range(70)}
    rows = [(i, speak(rnd, stems[x], 30), x) for i, x in enumerate([*stems] * 4 + ["l00"] * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_model(df, sample=700, least=4)
    assert model.labels == sorted(stems)
    got = language.identify(df, model, keep=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'ff61ff20C3' AS string) AS text, 'aa' AS lang")
    model = language.train_model(spark.createDataFrame([(1, "the ing", "aa"), (2, "eau que", "bb")], "doc_id long, text string, lang string"))
    assert language.identify(df, model, spans=True).count() == 1


def test_features_stay_in_their_word():
    alone = [sorted(int(x) for f in crf.word_features([w])[0] for x in f if x != 1 << crf.BITS) for w in (b"abc", b"a", b"\xc3\xa9tat")]
    feats, start = crf.word_features([b"abc", b"a", b"\xc3\xa9tat"])
    ends = [*start[1:], len(feats[0])]
    assert alone == [sorted(int(x) for f in feats for x in f[a:b] if x != 1 << crf.BITS) for a, b in zip(start, ends)]


def speak(rnd, stems, n):
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))) for _ in range(n))


TONGUES = {"aa": ["the", "ing", "wh"], "bb": ["sch", "ung", "ei"], "cc": ["eau", "que", "ais"]}


def test_language_of_words_never_seen(spark, odd, empty):
    rnd = random.Random(4)
    rows = [(i, speak(rnd, TONGUES[x], rnd.randint(3, 200)), x) for i, x in enumerate(rnd.choices(list(TONGUES), k=240))]
    rows += [(900, None, "aa"), (901, " 12 !\n", "aa"), (902, "", "bb"), (903, speak(rnd, TONGUES["aa"], 40) + " " + speak(rnd, TONGUES["bb"], 90), "bb"), (None, "theing", "aa"), (5, "quais eau", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    model = language.train_model(language.learning_rows(df))
    got = language.identify(df, model, keep=("lang",)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    right = [r.lang == r.lang_pred for r in got if r.lang and r.doc_id not in (900, 901, 902)]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert language.identify(empty, model).collect() == []
    assert {r.lang_pred for r in language.identify(df, language.train_model(empty)).collect()} == {"und"}


def test_toxic_spans_of_forms_never_seen(spark, odd, empty):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        words = speak(rnd, TONGUES["aa"], rnd.randint(5, 120)).split()
        bad = rnd.random() < 0.3
        for _ in range(4 * bad):
            words.insert(rnd.randrange(len(words)), "zorka" + speak(rnd, TONGUES["cc"], 1))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    bad_ids = {i for i, t in rows if "zorka" in t}
    rows += [(900, None), (901, ""), (None, "the the"), (0, rows[0][1])]
    labels += [(1, 0, None), (None, 0, 1), (7, None, 0), (7, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "0 AS score")
    model = toxicity.train_model(toxicity.sampled_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    assert np.mean([(r.doc_id in bad_ids) == bool(r.predicted) for r in got]) > 0.98
    text = dict(rows)
    marked = [text[r.doc_id][s.start : s.end] for r in got for s in r.spans]
    assert len(marked) > 300 and np.mean([m.startswith("zorka") for m in marked]) > 0.98
    assert toxicity.score_documents(empty, model).collect() == []
    assert {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0}
