"""Filter cascades and URL verdicts against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runledger.llm import cascade, urls
from runledger.llm.queries import URL_RULES


def split(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (not p or p[0] == "/")]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int, _keys string").repartition(3)
    found = urls.judge(pages, spark.createDataFrame(rules, "action string, host string, path string"), **options)
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())


ODD = [None, "", "no mark", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://com/",
       "http://example.com/en", "http://example.com/en/", "http://xexample.com/en/", "http://x.example.com/en/../",
       "http://a.net/es/", "http://a.net/ES/", "http://net/fr/", "http://a.net:80/es/", "http://a.net?/es/", "http://.net/es/",
       "http://a.net./es/", "http://É.net/fr/É", "http://" + "a." * 3000 + "net/es/", "http://x.net/" + "es/" * 40000,
       "x\n://example.com/en/\n?", "http://a.com#/en/"]


def test_fixed_rules(spark):
    rows = [(i, u, 1, "k") for i, u in enumerate(ODD)] + [(3, "://", 1, "k")]
    assert judged(spark, rows, URL_RULES) == sorted((i, *brute(u, URL_RULES)) for i, u, *_ in rows)


@pytest.mark.parametrize("per_shard", [1 << 22, 80])
def test_many_rules(spark, monkeypatch, per_shard):
    monkeypatch.setattr(cascade, "KEYS_PER_SHARD", per_shard)
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (rng.choice(urls.ACTIONS), h, p) for h, p in ((host(), rng.choice([path(), ""])) for _ in range(150))}.values())
    rules += [("block", rules[0][1], rules[0][2]), (None, "a", "/"), ("allow", None, "/"), ("allow", "a", "x")]
    rows = [(i, f"http://{host()}{path()}?q", 0, "k") for i in range(1500)]
    usable = [r for r in rules if None not in r]
    wanted = sorted((i, *brute(u, usable, "block")) for i, u, *_ in rows)
    assert judged(spark, rows, rules, default="block") == wanted
    assert len({w[3] for w in wanted}) > 50


def test_no_rules_and_no_pages(spark):
    rows = [(1, "http://a.com/x", 0, "k")]
    assert judged(spark, rows, []) == [(1, "a.com", "/x", None, "allow")]
    assert judged(spark, [], URL_RULES) == []
    with pytest.raises(ValueError):
        judged(spark, rows, [("deny", "a", "/")])


@pytest.mark.parametrize("n_listed, per_shard", [(0, 1 << 22), (5, 1 << 22), (500, 300)])
def test_cascade_is_exact(spark, monkeypatch, n_listed, per_shard):
    """Every key of the universe is answered rightly, with copies, a null and foreign listed keys beside."""
    monkeypatch.setattr(cascade, "KEYS_PER_SHARD", per_shard)
    keys = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id") % 15_000)).alias("key"))
    pairs = keys.filter("key is not null").select(cascade.hash_pair(F.col("key")).alias("p")).select("p.*")
    listed = spark.range(n_listed).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    found = cascade.build(listed.select(cascade.hash_pair(F.col("key")).alias("p")).select("p.*"), pairs)
    rows = keys.withColumn("pairs", F.when(F.col("key").isNotNull(), F.array(cascade.hash_pair(F.col("key")))))
    answers = {r.key: r.hit for r in found.mark(rows, F.col("pairs"), "hit").collect()}
    true = {f"k{i * 7}" for i in range(n_listed)}
    assert answers.pop(None) is None
    assert all(hit == [key in true] for key, hit in answers.items())
    assert (found.levels >= 2) or n_listed < 10
    if per_shard == 300:
        assert found.shards == 2
