"""Texts of 10 MB through the operators on turns, search and lines."""

import hashlib

from foldsmith.llm import lines, search, trie
from tests.llm.test_search import brute

SIZE = 10_000_000


def test_lines(spark):
    one = "the same line again\n" * (SIZE // 20)
    other = "\n".join(f"line number {i} of a long text" for i in range(SIZE // 32))
    docs = spark.createDataFrame([(1, one), (2, other + "\nthe same line again"), (3, "x" * SIZE)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[1].text) == (SIZE // 20 + 1, 0, one)
    assert (got[2].n_lines, got[2].n_dropped, got[2].text) == (SIZE // 32 + 1, 1, other)
    assert (got[3].n_lines, got[3].n_dropped, len(got[3].text)) == (1, 0, SIZE)


def test_search(spark):
    docs = [(1, "needle " + "hay " * (SIZE // 4)), (2, "n" * SIZE), (3, "needle in hay")]
    items = [(1, "needle hay"), (2, "n" * SIZE), (3, "hay " * (SIZE // 4))]
    got = search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_trie(spark):
    turns = spark.createDataFrame([(20, 0, "user", "word " * (SIZE // 5)), (40, 0, "user", "word " * (SIZE // 5)), (40, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    rows = sorted((r.depth, r.n_convs, r.saved_tokens, r.ends_sha256) for r in trie.prefix_nodes(turns).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows == [(0, 2, SIZE // 5, sha("")), (1, 2, SIZE // 5, sha("20")), (2, 1, 0, sha("40"))]
