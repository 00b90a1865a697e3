import numpy as np
import pytest

from siftline.llm.urls import BUCKETS, LABELLED, MAX_LABELLED, RULES, filter_urls, fit_urls, labelled_rows, score_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    best = None
    for verdict, rule in RULES:
        at, slash, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


URLS = [
    None, "", "no scheme/at/all", "http://", "HTTP://WWW.Example.ORG/es/1", "https://a.example.org/en/12?x=://y", "https://a.example.org/en/2",
    "http://org", "http://org/", "http://x.org?y=/", "http://x.ORG/#a", "http://b.com/fr/3", "http://b.com/de/", "http://b.com/de", "http://com/de/4",
    "http://notcom/de/4", "http://www.casino-win.example.net/en/9", "http://blog.garden.example.net/fr/9", "ftp://É.example.com/fr/é",
    "x://y://z.org/a", "http://example.org/en/1", "http://user@h.org:80/p", "http://line\nbreak.org/a\nb", "http://" + "a" * 5000 + ".com/en/" + "b" * 5000,
]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def test_hosts_paths_and_rules(spark, labelled):
    rows = [(k, url, "x", "y") for k, url in enumerate(URLS)] + [(None, URLS[4], "x", "y"), (4, URLS[4], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    found = filter_urls(pages, labelled, RULES).collect()
    want = [(k, *parts(url), rule_of(*parts(url))[0]) for k, url, *_ in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=repr) == sorted(want, key=repr)
    for r in found:
        verdict = rule_of(r.host, r.path)[1]
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    by_id = {r.page_id: r.verdict for r in found}
    assert by_id[16] == "block" and by_id[17] == "allow"


def test_held_out_accuracy():
    bad = [f"{a}.{n}.example.{e}" for n in ("casino-royal", "bets-free", "cheap-pill", "spam-farms", "adult-xx", "ads-tracks") for a in ("www", "m") for e in ("com", "net")]
    good = [f"{a}.{n}.example.{e}" for n in ("mountain", "history", "thering", "ononst", "painting", "ministry") for a in ("www", "blog") for e in ("com", "net")]
    model = fit_urls([(u.split("/", 3)[2], "/" + u.split("/", 3)[3], y) for u, y in LABELLED])
    scores = score_urls(model, bad + good, ["/en/5"] * (len(bad) + len(good)))
    assert (scores[: len(bad)] > 0).mean() >= 0.9 and (scores[len(bad) :] <= 0).mean() == 1


def test_fit_is_the_regression_it_says():
    model = fit_urls([("bad.com", "/", 1), ("good.com", "/", 0)])
    scores = score_urls(model, ["bad.com", "good.com"], ["/", "/"])
    assert scores[0] > 1 and scores[1] < -1 and model.weights.shape == (BUCKETS,)
    assert np.array_equal(model.weights, fit_urls([("bad.com", "/", 1), ("good.com", "/", 0)]).weights)


def test_empty_and_large_tables(spark, labelled):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert filter_urls(none, labelled, RULES).collect() == []
    pages = spark.createDataFrame([(1, "http://casino-win.example.com/en/1")], "page_id bigint, url string")
    assert filter_urls(pages, spark.createDataFrame([], "url string, label int")).collect()[0].verdict == "allow"
    large = spark.range(MAX_LABELLED + 1).selectExpr("'http://a.b/' url", "1 label")
    with pytest.raises(ValueError):
        labelled_rows(large)
