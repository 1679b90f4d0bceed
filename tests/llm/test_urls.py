"""Hosts, paths and rules against a plain version; the models against a plain version."""

import math
import zlib
from collections import Counter

import pytest

from ..conftest import TESTDATA
from keystrata.llm import url_filter
from keystrata.llm.queries import URL_RULES
from keystrata.llm.url_filter import ALPHABET, LEAST_SEEN, ORDER, OTHER, START, SYMBOLS

URLS = [
    "http://a.example.com/en/71?x=/en/", "https://EXAMPLE.com/en/8", "ftp://b.net/de/8#a/b", "http://example.net/de/8/9", "x.org/es/", None, "", "http://", "://", "http://com/en/", "http://xcom/en/1",
    "http://a.org/es", "http://a.org/es/?q", "http://a.org/fr/7", "HTTP://Ä.COM/en/ü", "http://u@h.com:80/en/a", "a://b://c.com/en/", "http://h.net?x", "http://h.net#/de/", "http://example.com/en/7", "http://example.com/en/7",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path[:end]


def rule(host, path):
    fits = []
    for text, verdict in URL_RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((-len(text), text, verdict))
    return min(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, u, "h", 1.5) for i, u in enumerate(URLS)], "page_id int, url string, host string, score double").repartition(2)
    return {r["page_id"]: r for r in url_filter.filter_urls(df, URL_RULES).collect()}


def test_hosts_paths_and_rules(judged):
    assert len(judged) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        text, verdict = rule(host, path)
        r = judged[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, text)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_rules_of_the_contract(spark):
    """Each rule's word, written out here, with a url that it alone decides."""
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(URL_RULES) == words
    urls = {"http://a.com/en/1": "com/en/", "http://b.example.com/en/71": "example.com/en/7", "http://c.net/de/1": "net/de/", "http://example.net/de/81": "example.net/de/8", "http://d.org/es/": "org/es/"}
    got = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), URL_RULES).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got} == {u: (r, words[r]) for u, r in urls.items()}


def symbols(url):
    low = url.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return START * ORDER + "".join(c if c in ALPHABET else OTHER for c in low)


def model(urls, others):
    """Chance of a character after its context, from the counts of ``urls``; contexts stay by their counts in both kinds."""
    counts = [Counter(s[i - n : i + 1] for s in map(symbols, x) for i in range(ORDER, len(s)) for n in range(ORDER + 1)) for x in (urls, others)]
    seen, kinds, both = Counter(), Counter(), Counter()
    for k, of in enumerate(counts):
        for g, n in of.items():
            both[g[:-1]] += n
            if k == 0:
                seen[g[:-1]] += n
                kinds[g[:-1]] += 1

    def chance(context, c):
        p = 1 / SYMBOLS
        for n in range(ORDER + 1):
            x = context[len(context) - n :]
            if seen[x] and (not n or both[x] >= LEAST_SEEN):
                p = (counts[0][x + c] + kinds[x] * p) / (seen[x] + kinds[x])
        return p

    return chance


def test_scores_are_log_ratios(spark):
    urls = [f"http://h{i % 7}.example.com/en/{i}{'?a=b' * (i % 3)}" for i in range(60)] + [u for u in URLS if u]
    rules = [("h1.example.com/", "allow"), ("h2.example.com/", "block"), ("h3.example.com/", "block"), ("h4.example.com/", "allow")]
    verdicts = {n.rstrip("/"): v for n, v in rules}
    got = {r["url"]: r["score"] for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    training = {u for u in urls if zlib.crc32(u.encode()) % 2 == 0}
    kinds = {v: [u for u in training if verdicts.get(parts(u)[0]) == v] for v in ("allow", "block")}
    assert all(kinds.values())
    yes, no = model(kinds["allow"], kinds["block"]), model(kinds["block"], kinds["allow"])
    for url in urls:
        s = symbols(url)
        ratios = [math.log(yes(s[k - ORDER : k], s[k])) - math.log(no(s[k - ORDER : k], s[k])) for k in range(ORDER, len(s))]
        assert got[url] == pytest.approx(sum(ratios) / len(ratios), abs=1e-9)


def test_every_context_counts(spark):
    """More contexts than the model once kept: scores are those of all of them, the rarest included, whatever is broadcast."""
    code = lambda i: "".join(chr(97 + (i * 7919 + i * i * 31) // 26**k % 26) for k in range(5))
    urls = [f"x://{('good', 'bad')[i % 2]}/{code(i)}{code(i % 1900 + 5000)}/{i % 100}" for i in range(6000)]
    rules = [("good/", "allow"), ("bad/", "block")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {hot: {r["url"]: (r["score"], r["verdict"]) for r in url_filter.filter_urls(df, rules, hot=hot).collect()} for hot in (0, 50, url_filter.HOT)}
    assert got[0] == got[50] == got[url_filter.HOT]
    training = {u for u in urls if zlib.crc32(u.encode()) % 2 == 0}
    kinds = [[u for u in training if u.startswith(f"x://{k}/")] for k in ("good", "bad")]
    both = Counter(s[i - n : i] for k in kinds for s in map(symbols, k) for i in range(ORDER, len(s)) for n in range(ORDER + 1))
    assert sum(n >= LEAST_SEEN for n in both.values()) > 12_000
    yes, no = model(*kinds), model(*kinds[::-1])
    for url in urls[::7]:
        s = symbols(url)
        ratios = [math.log(yes(s[k - ORDER : k], s[k])) - math.log(no(s[k - ORDER : k], s[k])) for k in range(ORDER, len(s))]
        assert got[50][url][0] == pytest.approx(sum(ratios) / len(ratios), abs=1e-9)


def test_recalls_on_the_tables(spark):
    """Both kinds of rule-decided URLs are told apart in the half that did not train the models."""
    pages = spark.read.parquet(str(TESTDATA / "sf0.1" / "pages.parquet")).select("page_id", "url")
    _, least, held = url_filter.fitted(url_filter.prepared(pages, URL_RULES)[1])
    found = url_filter.recalls(held, least).first()
    assert found["n_accepted"] > 20 and found["n_rejected"] > 200
    assert found["accepted"] > 0.85 and found["rejected"] > 0.85


def test_blended_chances_sum_to_one():
    chance = model(["http://a.example/b", "http://b.example/"], [])
    for context in ("^http", "^^^^^", "xyz/a", "zzzzz"):
        assert sum(chance(context, c) for c in ALPHABET + OTHER + START) == pytest.approx(1)


def test_models_part_kinds_of_urls(spark):
    good = [f"http://news{i}.example.com/article/{i}-story-of-the-day" for i in range(60)]
    bad = [f"http://x{i}.example.com/casino/win{i}/free-bets-now" for i in range(60)]
    rows = [(f"{u}", "allow" if u in good[:40] else "block" if u in bad[:40] else None) for u in good + bad]
    rules = [(u.split("://")[1], v) for u, v in rows if v]
    df = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.filter_urls(df, rules).collect()}
    assert all(got[u] == "allow" for u in good[40:]) and all(got[u] == "block" for u in bad[40:])


def test_nothing_and_one_kind(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert url_filter.filter_urls(df, URL_RULES).count() == 0
    one = spark.createDataFrame([("http://a.com/en/",), ("http://b.fr/",)], "url string")
    assert sorted((r["verdict"], r["score"]) for r in url_filter.filter_urls(one, URL_RULES).collect()) == [("allow", 0.0), ("block", 0.0)]
