import math
import re
from collections import Counter

import pytest

from tabweave.llm import url_filter

URLS = ["http://A.example.ORG/es/1?x#y", "http://example.org/en/17", "http://example.org/en/27", "https://www.shop.com/fr/", "ftp://com/de/x", "http://fooorg/", "http://x.net/?q=http://a.org/", "http://a.org", "no address", None, "x://y://z.org/p", "http://A.example.ORG/es/1?x#y"]
WANT = [
    ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("example.org", "/en/27", "org/", "allow"), ("www.shop.com", "/fr/", "com/fr/", "allow"),
    ("com", "/de/x", "com/de/", "block"), ("fooorg", "/", None, None), ("x.net", "/", None, None), ("a.org", "", None, None), ("", "", None, None), ("", "", None, None), ("y:", "//z.org/p", None, None), ("a.example.org", "/es/1", "example.org/es/", "block"),
]


def test_rules(spark):
    rows = [(i, u, "<html><title>the foo org</title>") for i, u in enumerate(URLS)]
    got = sorted(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    for r, (host, path, rule, verdict) in zip(got, WANT, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if verdict else r.verdict in ("allow", "block"))


def test_segmenter():
    s = url_filter.Segmenter({"the": 50, "best": 20, "shop": 30, "be": 5, "st": 5, "t": 1})
    assert s.split("thebestshop") == ["the", "best", "shop"] and s.split("") == [] and "".join(s.split("zzthe")) == "zzthe"


def test_learns_from_rules(spark):
    rows = [(i, f"http://badsite{i % 7}.example.org/es/{i}", "<title>bad site good</title>") for i in range(60)] + [(100 + i, f"http://goodsite{i % 7}.example.org/de/{i}", None) for i in range(60)] + [(200, "http://badsite.net/es/1", None), (201, "http://goodsite.net/de/7", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[200] == "block" and got[201] == "allow"


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("head, words, hot", [(50_000, 200_000, 1000), (3, 200_000, 1000), (3, 2, 1000), (3, 2, 2)])
def test_rare_tokens_and_words_count_in_full(spark, monkeypatch, head, words, hot):
    monkeypatch.setattr(url_filter, "HEAD", head)
    monkeypatch.setattr(url_filter, "WORDS", words, raising=False)
    monkeypatch.setattr(url_filter, "HOT", hot, raising=False)
    kinds = ["red", "bluegreen", "teacup", "cupred", "greentea"]
    rows = [(i, f"http://{kinds[i * i % 5]}.example.org/{('es', 'de')[i % 2]}/{kinds[i % 4]}/{i}", f"<title>{' '.join(['red blue green tea cup', 'tea cup', 'red'][: 1 + i % 3])}</title>") for i in range(60)]
    rows += [(100 + i, f"http://{kinds[i % 5]}{i % 3}.net/{kinds[i % 4]}/{kinds[(i + 1) % 5]}", None) for i in range(20)] + [(200, None, None), (201, "http://cupteared.net/cupred", None), (201, "http://cupteared.net/cupred", None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    titles = Counter(w for *_, html in rows for w in re.findall("[a-z]+", (html or "").removeprefix("<title>").removesuffix("</title>")))
    segmenter = url_filter.Segmenter(titles)
    ruled = {v: Counter(t for r in got if r.rule and r.verdict == v for t in url_filter.tokens(r.host, r.path, segmenter)) for v in ("allow", "block")}
    docs = {v: sum(1 for r in got if r.rule and r.verdict == v) for v in ruled}
    kinds = len(set(ruled["allow"]) | set(ruled["block"])) + 1
    log = {v: lambda t, v=v: math.log((ruled[v][t] + 1) / (sum(ruled[v].values()) + kinds + 1)) for v in ruled}
    assert len(got) == len(rows) and min(docs.values()) > 0
    for r in got:
        want = math.log((docs["block"] + 1) / (docs["allow"] + 1)) + sum(log["block"](t) - log["allow"](t) for t in url_filter.tokens(r.host, r.path, segmenter))
        assert math.isclose(r.block_odds, want, abs_tol=1e-9)
        assert r.rule or r.verdict == ("block" if r.block_odds > 0 else "allow")


def test_words_of_any_length_split_names():
    s = url_filter.Segmenter({"internationalisationsdienstleistungen": 9, "net": 5, "shop": 5})
    assert s.split("internationalisationsdienstleistungenshop") == ["internationalisationsdienstleistungen", "shop"]
    assert s.split("netinternationalisationsdienstleistungen", {"netin": 1}) == ["net", "internationalisationsdienstleistungen"]
