import random

from foldsmith.llm import urls


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = ""
    for c in rest[len(host) :]:
        if c in "?#":
            break
        path += c
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def rows():
    rnd = random.Random(1)
    out = [(i, f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'm.', 'WWW.', 'É.'])}{rnd.choice(['example', 'notexample', 'x'])}.{rnd.choice(['com', 'net', 'org', 'NET', ''])}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{rnd.choice('6789')}{rnd.choice(['', '?a=1&b=2', '#x', '/'])}") for i in range(300)]
    return out + [(400, None), (401, ""), (402, "example.com/en/1"), (403, "http://"), (404, "a://b://com/en/"), (405, "://com/en/"), (406, "http://com/en/"), (407, "http://com?/en/"), (None, "http://net/de/1"), (1, out[1][1]), (408, "http://xcom/en/"), (409, "http://com/en/" + "1" * 5000), (410, "http://a\nb.com/en/\n?")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows()], "page_id long, url string, html string, host string")
    got = urls.filter_urls(df).collect()
    want = sorted((str(i), *map(str, brute(u))) for i, u in rows())
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    verdict = {h + p: v for v, h, p in urls.RULES}
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)


def test_every_feature_against_brute_force(spark):
    import math
    from collections import Counter

    extra = [(500, "http://0000000000xxxxxxxxxx.com/x1x/23?x=1&y=2&3"), (501, "0123456789"), (502, "xxx"), (503, "http://h/" + "é" * 3 + "😀😀/a//b?")]
    df = spark.createDataFrame(rows() + extra, "page_id long, url string")
    host, path = urls.host_and_path(df.url)
    cols = urls.lexical(df.url, host, path)
    for r in df.select("url", *(c.alias(k) for k, c in cols.items())).collect():
        url = r.url or ""
        own_host, own_path, _ = brute(url)
        n, count = max(len(url), 1), Counter(url)
        want = {
            "f_length": n, "f_depth": own_path.count("/") + 1, "f_digits": sum(count[c] for c in "0123456789") / n,
            "f_entropy": -sum(x / n * math.log(x / n) for x in count.values()), "f_params": url.count("?") + url.count("&"), "f_host_labels": own_host.count(".") + 1,
        }
        assert {k: round(r[k], 9) for k in want} == {k: round(x, 9) + 0.0 for k, x in want.items()}, url


def test_suffix_statistics_by_broadcast_and_by_shuffle(spark):
    from collections import Counter

    labels = [(i, f"a.{'com' if i % 2 else f's{i % 40}'}", ["block", "allow", None][i % 3]) for i in range(400)] + [(900, "", None), (901, "z.new", None)]
    df = spark.createDataFrame(labels, "i int, host string, _label string")
    n, bad = (Counter(h.split(".")[-1] for _, h, x in labels if x in kinds) for kinds in (("block", "allow"), ("block",)))
    for limit in (100, 5):
        got = urls.with_suffix_statistics(df, limit).collect()
        assert len(got) == len(labels)
        for r in got:
            s = r.host.split(".")[-1]
            assert round(r.f_suffix_rate, 9) == round((bad[s] + 1) / (n[s] + 2), 9) and round(2.718281828459045**r.f_suffix_n, 6) == n[s] + 1


def test_trees_on_held_out_urls(spark):
    """URLs of a known kind that no rule fits: the rules' labels are long digit paths, or short ones without."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    url = lambda tld, bad: f"http://{word(5)}.{tld}/k/{word(4)}" + (f"{rnd.randrange(10**12)}?{word(2)}=1&{word(1)}=2" if bad else "")
    train = [(i, url("bad" if i % 2 else "good", i % 2)) for i in range(400)]
    held = [(1000 + i, url("other", i % 2)) for i in range(200)]
    rules = [("block", "bad", "/k/"), ("allow", "good", "/k/")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(train + held, "page_id long, url string"), rules).collect()}
    assert all(got[i].rule is None for i, _ in held)
    assert sum((got[i].verdict == "block") == bool(i % 2) for i, _ in held) >= 195


def test_few_labels(spark):
    schema = "page_id long, url string"
    for urls_, want in (([], set()), (["http://a.fr/"], {"allow"}), (["http://com/en/1", "http://a.fr/"], {"block"}), (["http://net/de/1", None], {"allow"})):
        df = spark.createDataFrame(list(enumerate(urls_)), schema)
        assert {r.verdict for r in urls.filter_urls(df).collect()} == want


def test_no_python_in_the_plan(spark):
    plan = urls.filter_urls(spark.createDataFrame(rows(), "page_id long, url string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_pages(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
