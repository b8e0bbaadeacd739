import corpus_pipeline as p
from foldsmith.llm import language
from foldsmith.session import materialize, table
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_repetition import brute as brute_quality
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    extra = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "12 13 " * 9 + "14 15 16 17 18", "en", "s", 3), (5003, docs.first().text, "en", "s", 1), (3, docs.first().text + " x", "en", "s", 1)]
    item = table(spark, SF, "benchmark").first().text
    extra += [(5004, " ".join(r.text for r in docs.limit(2).collect()) + "\n" + item, "en", "s", 1)]
    docs = materialize(docs.union(spark.createDataFrame(extra, docs.schema)), "t")
    assert [n for n, _ in p.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "SentencePiece"]
    rows = docs.collect()
    for name, stage in p.STAGES:
        out = materialize(stage(spark, docs, SF), "t")
        got = sorted((str(r.doc_id), getattr(r, "text", None) or "") for r in out.collect())
        if name == "quality rules":
            want = [r for r in rows if brute_quality(r.text)[-1]]
        elif name == "language ID":
            model = language.train_model(language.learning_rows(docs))
            want = [r for r, x in zip(rows, language.identify(docs, model).collect()) if x.lang_pred != "und" and x.score >= 0.5]
            assert len(want) >= len(rows) - 2 and all(any(map(str.isalpha, r.text)) for r in want)
        elif name == "SimHash near-dedup":
            root = brute_components([brute_fp(r.text) for r in rows])
            best = {}
            for r, x in zip(rows, root):
                if x not in best or (r.doc_id, r.text) < (best[x].doc_id, best[x].text):
                    best[x] = r
            want = list(best.values())
            assert len(want) < len(rows)
        elif name == "benchmark decontamination":
            items = [(r.item_id, lower(r.text)) for r in table(spark, SF, "benchmark").collect()]
            bad = {who for who, *_ in brute_items([(i, lower(r.text)) for i, r in enumerate(rows)], items)}
            want = [r for i, r in enumerate(rows) if i not in bad]
            assert bad
        else:
            assert out.count() == len(rows) and all(r.round_trip for r in out.collect())
            break
        assert got == sorted((str(r.doc_id), r.text or "") for r in want), name
        assert out.columns == docs.columns
        docs, rows = out, out.collect()


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.isEmpty()
