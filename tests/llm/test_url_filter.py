import random

import pytest

from flowlens.llm import url_filter
from flowlens.llm.url_filter import RULES, build_cascade, judge

URLS = [
    "http://a.example.org/es/1", "https://example.org/es/", "http://EXAMPLE.org/en/12?x=1", "http://example.org/en/2",
    "http://notexample.org/es/1", "http://org/", "http://x.com/fr/9#a", "http://x.com/fr", "http://com/de/", "x", None, "",
    "://", "ftp://a.com/de/://b", "http://a.com?/de/", "http://a.com#/de/", "http://b.net/de/1", "http://a.ORG", "http://É.com/DE/",
    "http://.org/x", "http://a..com/de/x", "http://" + "a" * 100_000 + ".com/de/" + "b" * 100_000, "HTTP://A.B.Com/de/?q",
]


def brute(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host) :]
    for stop in "?#":
        path = path.split(stop)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in rules:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best, rules[best] if best else "allow"


@pytest.mark.parametrize("rules", [RULES, {"org/": "block"}, {}])
def test_verdicts_equal_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(URLS)], "page_id bigint, url string, host int, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge(pages, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("listed,others,seed", [(1, 500, 0), (40, 3000, 1), (700, 700, 2)])
def test_cascade_is_exact_on_its_universe(spark, listed, others, seed):
    dice = random.Random(seed)
    keys = [f"key{dice.randrange(10**9)}" for _ in range(listed + others)]
    inside = spark.createDataFrame([(k,) for k in keys[:listed]], "key string")
    universe = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "key string")
    cascade = build_cascade(inside, universe, 10)  # too low a count makes for more levels, not for errors
    got = {r[0] for r in universe.where(cascade.contains(universe["key"])).collect()}
    assert got == set(keys[:listed])
    assert listed == 1 or len(cascade.levels) >= 2


def test_ten_thousand_rules_of_many_shapes(spark):
    dice = random.Random(5)

    def host():
        return ".".join(f"{dice.choice('abcdefgh')}{dice.randrange(40)}" for _ in range(dice.randrange(1, 5)))

    def path(most):
        return "/" + "".join(dice.choice("ab/") for _ in range(dice.randrange(most)))

    rules = {}
    while len(rules) < 10_000:
        rules[host() + path(12)] = dice.choice(["allow", "block"])
    known = list(rules)
    urls = [f"http://{host()}{path(40)}" for _ in range(1500)] + [f"http://{host()}.{dice.choice(known)}{path(9)}?q" for _ in range(1500)]
    got = judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules)
    by_host = {}
    for rule in rules:
        by_host.setdefault(rule.partition("/")[0], []).append(rule)
    for row in got.collect():
        host_of, path_of, _, _ = brute(urls[row["page_id"]], {})
        labels = host_of.split(".")
        near = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), [])]
        # of fitting rules of one length the greatest
        fits = max(((len(r), r) for r in near if path_of.startswith(r[r.index("/") :])), default=(0, None))[1]
        assert tuple(row) == (row["page_id"], host_of, path_of, fits, rules.get(fits, "allow"))


def test_list_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_FILTER_BITS", 10)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    with pytest.raises(ValueError, match="bound"):
        judge(pages)


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
