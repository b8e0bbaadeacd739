import random

from foldsmith.llm import decontamination as d


def brute(docs, items):
    """Every passage against every item, by shingles alone."""
    out = set()
    by = {}
    for i, t in items:
        words = (t or "").lower().split()
        if i is not None and words:
            by.setdefault((len(words) + 1).bit_length(), []).append((i, words))
    for group in by.values():
        s = max(16, max(len(w) for _, w in group) * 5 // 4)
        for who, text in docs:
            words = (text or "").lower().split()
            for lo in range(0, max(1, len(words)), s):
                own = words[lo : lo + 2 * s]
                for i, want in group:
                    k = min(5, len(want))
                    have = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
                    hit = [tuple(want[j : j + k]) in have for j in range(len(want) - k + 1)]
                    if sum(hit) >= 0.8 * len(hit) - 1e-9 and sum(hit):
                        out.add((who, i, sum(hit) == len(hit)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rnd.choice(vocab[: rnd.choice((20, 300))]) for _ in range(n)]
    items = [(i, " ".join([*say(n), "Ende?", *say(n // 3 + 1)])) for i, n in enumerate([1, 3, 6, 12, 20, 30, 40, 64, 90, 25, 33, 28])]
    items += [(50, None), (51, ""), (None, "a b c d e f"), (52, items[4][1])]
    docs = [(100 + i, " ".join(say(rnd.randrange(300)))) for i in range(30)] + [(1, None), (2, ""), (3, "\n")]
    for i, (_, t) in enumerate(items):
        for edits in (0, 1, 2, 4):
            words = (t or "").split()
            for _ in range(edits):
                if words:
                    words[rnd.randrange(len(words))] = "x"
            docs.append((1000 + 10 * i + edits, " ".join([*say(rnd.randrange(200)), *words, *say(rnd.randrange(200))])))
    docs += [docs[-3]]
    df = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, item_id string")
    got = d.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == {(a, b) for a, b, _ in want}
    assert len({r.doc_id for r in got}) > 20
    assert d.contaminated(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert d.contaminated(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_an_item_of_one_repeated_word_beside_a_normal_item(spark):
    """Items of one or two distinct words have no term that cannot be missing, but they neither hide other items nor are lost."""
    rnd = random.Random(6)
    say = lambda n: [f"w{rnd.randrange(90)}" for _ in range(n)]
    items = [(1, "w1 " * 12), (2, " ".join(say(12))), (3, " ".join(say(11))), (4, "w2 w3 " * 7), (5, "rare " * 13), (6, " ".join(say(14)))]
    docs = []
    for i, (_, t) in enumerate(items):
        for n in (0, 30, 200):
            docs.append((10 * i + n, " ".join([*say(n), *t.split(), *say(n), "w1"])))
    docs += [(1000 + i, " ".join(say(60))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    own = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b) for a, b, _ in brute(docs, items)}
    assert len(want) >= 3 * len(items)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, own).collect()} == want
    kept = {r.doc_id for r in d.drop_contaminated(df, own).collect()}
    assert kept == {a for a, _ in docs} - {a for a, _ in want}


def test_an_item_without_an_id_counts_but_has_no_name(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "seven"), (None, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three four five six")], "item_id long, text string")
    assert d.contaminated(docs, items).collect() == []
    assert [r.doc_id for r in d.drop_contaminated(docs, items).collect()] == [2]


def test_words_of_question_and_answer_are_cut_at_ascii_white_space():
    assert d.split_answer("a\u00a0b c? d e") == 2 and d.split_answer("a\u3000b c d e f") == 3 and d.split_answer("One. Two three.") == 1


def test_scores_do_not_depend_on_the_passes(spark, monkeypatch):
    rnd = random.Random(12)
    items = [(i, " ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randint(3, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(i, f"u v {t} z") for i, t in items], "doc_id long, text string")
    own = spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(docs, own).collect()}
    monkeypatch.setattr(d, "INDEX_ITEMS", 7)  # read by the driver alone
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(docs, own).collect()} == want
    assert len(want) >= 60
