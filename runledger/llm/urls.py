"""Verdicts on URLs by rules for hosts and paths, looked up in filter cascades."""

from pyspark.sql import functions as F

from runledger.llm import cascade
from runledger.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIONS = ("allow", "block")
_PARTS = r"://([^/?#]*)([^?#]*)"


def lowered(column):
    return F.translate(column, UPPER, LOWER)


def host_of(url):
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lowered(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url):
    """What follows the host up to `?`, `#` or the end; empty without a host mark."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _labels(host):
    return F.size(F.split(host, r"\.", -1))


def _rule_keys(rules):
    """(key, action) of the rules that can fit a URL; a key with both actions blocks."""
    usable = rules.select(lowered("host").alias("host"), "path", "action").filter(
        "host is not null and path is not null and action is not null and (path = '' or path like '/%')")
    strange = usable.filter(~F.col("action").isin(*ACTIONS)).take(1)
    if strange:
        raise ValueError(f"the action of a rule is allow or block, not {strange[0]['action']!r}")
    return usable.groupBy("host", "path").agg(F.max("action").alias("action"))


def _candidates(host, path, labels, lengths):
    """Keys of all rules that could fit, longest first: host endings by labels, path beginnings by length."""
    endings = F.filter(F.array(*map(F.lit, labels)), lambda k: k <= _labels(host))
    begins = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path))
    keys = F.flatten(F.transform(endings, lambda k: F.transform(begins, lambda n: F.struct(
        F.call_function("substring_index", host, F.lit("."), -k).alias("host"),
        F.call_function("substring", path, F.lit(1), n).alias("path")))))
    ranked = F.array_sort(F.transform(keys, lambda k: F.struct(
        (-F.char_length(k["host"]) - F.char_length(k["path"])).alias("size"),
        (-F.char_length(k["host"])).alias("first"), F.concat(k["host"], k["path"]).alias("key"))))
    return F.transform(ranked, lambda k: k["key"])


def judge(pages, rules, default="allow", column="url"):
    """Pages with host, path, rule and verdict.

    `rules` has the columns host, path and action (allow or block). A rule fits its
    host and all subdomains, if the path begins with the rule's. The longest one that
    fits decides, of equally long ones that with the longer host; a rule with both
    actions blocks. Without one, rule is null and the verdict is `default`: the URL is
    on no list. The keys a URL could be listed under are cut by the numbers of labels and
    path lengths that the rules have, so a hostile URL gives no more of them than any other.

    Rules are looked up in two cascades: that of all rules, whose universe are the keys of
    all pages, and that of the blocking ones, whose universe are the rules. Nothing of the
    pages is shuffled but the keys that pass the first filter wrongly. Null URLs and such
    without `://` have an empty host and path. Rules with a null, or with a path that starts
    with anything but `/`, fit nothing. Repeated pages are judged alike; columns of the
    input that are called like a new one are replaced. No pages give no rows, no rules the default.
    """
    if default not in ACTIONS:
        raise ValueError("the default is allow or block")
    known = materialise(_rule_keys(rules), "rules")
    shape = known.agg(F.collect_set(_labels(F.col("host"))).alias("labels"),
                      F.collect_set(F.char_length("path")).alias("lengths")).first()
    parts = pages.withColumns({"host": host_of(F.col(column)), "path": path_of(F.col(column))})
    if not shape["labels"]:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = _candidates(F.col("host"), F.col("path"), sorted(shape["labels"]), sorted(shape["lengths"]))
    listed = known.select(cascade.hash_pair(F.concat("host", "path")).alias("k"), "action")
    ruled = listed.select("k.*")
    asked = pages.select(host_of(F.col(column)).alias("host"), path_of(F.col(column)).alias("path")).select(
        F.explode(F.transform(keys, cascade.hash_pair)).alias("k")).select("k.*")
    all_rules = cascade.build(ruled, asked)
    blocking = cascade.build(listed.filter(F.col("action") == "block").select("k.*"), ruled)

    spare = lambda name: "_" * (1 + max(len(c) for c in parts.columns)) + name
    keyed, hit, bad = spare("keys"), spare("hit"), spare("bad")
    rows = parts.withColumn(keyed, keys)
    rows = all_rules.mark(rows, F.transform(F.col(keyed), cascade.hash_pair), hit)
    place = F.array_position(hit, True)
    rule = F.when(place > 0, F.element_at(keyed, place.cast("int")))
    rows = rows.withColumn("rule", rule)
    rows = blocking.mark(rows, F.when(F.col("rule").isNotNull(), F.array(cascade.hash_pair(F.col("rule")))), bad)
    verdict = F.when(F.col("rule").isNull(), default).when(F.get(bad, F.lit(0)), "block").otherwise("allow")
    return rows.withColumn("verdict", verdict).drop(keyed, hit, bad)
