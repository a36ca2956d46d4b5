"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Sound patterns find the seeds. The words around a seed make lexical patterns;
the graph of patterns and the values they extract is scored for some rounds:
a pattern is as good as the share of trusted values among its own, a value as
good as the patterns that extract it. Good patterns then name identifiers of
other shapes that stand in the same contexts.
"""

from pyspark.sql import functions as F

from runledger.session import fits_broadcast, materialise

KINDS = ["email", "ip", "card", "phone"]

# Each expression finds exactly the leftmost non-overlapping matches of the plain
# form in its comment; look-behinds and possessive runs only spare retries that
# must fail, so that long runs of letters or digits take linear time.
EXPRESSIONS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word with at least four digits may be an identifier of a shape not known yet.
CANDIDATE = r"(?<!\S)(?:[^\s0-9]*+[0-9]){4}\S*+"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
CONTEXT_CHARS = 80

SPAN = "array<struct<start:int,end:int,value:string>>"


def _spans(matches, pieces):
    """Code point spans of matches, given the lengths of the texts between them."""
    return F.expr(f"""
        CASE WHEN size({matches}) > 0 THEN aggregate(
            sequence(0, size({matches}) - 1),
            struct(0 AS pos, CAST(array() AS {SPAN}) AS found),
            (acc, i) -> struct(
                acc.pos + {pieces}[i] + char_length({matches}[i]) AS pos,
                concat(acc.found, array(struct(
                    acc.pos + {pieces}[i] AS start,
                    acc.pos + {pieces}[i] + char_length({matches}[i]) AS end,
                    {matches}[i] AS value))) AS found)).found
        ELSE CAST(array() AS {SPAN}) END""")


def _luhn(value):
    """Whether the digits of a value pass the check digit rule."""
    return f"""(aggregate(sequence(1, char_length(regexp_replace({value}, '[^0-9]', ''))), 0, (acc, i) -> acc +
        CASE WHEN i % 2 = 1 THEN CAST(substr(regexp_replace({value}, '[^0-9]', ''), -i, 1) AS INT)
        ELSE CAST(substr('0246813579', CAST(substr(regexp_replace({value}, '[^0-9]', ''), -i, 1) AS INT) + 1, 1) AS INT)
        END) % 10 = 0)"""


VALID = {
    "email": "true",
    "ip": rf"x.value RLIKE '^{PART}([.]{PART}){{3}}$'",
    "card": _luhn("x.value"),
    "phone": "char_length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 10 AND 15",
}


def scan(docs):
    """One pass over docs(doc_id, text): base spans, and candidates with their contexts.

    Columns: doc_id, text_key (xxhash64 of the text), base (kind number, start,
    end) and instances (kind or null, start, end, value, left, right).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.coalesce("text", F.lit("")).alias("text"))
    gates = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"),
             "ip": F.col("text").rlike("[0-9][.][0-9]"), "card": F.col("text").rlike("[0-9](?:[ -]?[0-9]){13}"),
             "candidate": F.col("text").rlike("[0-9]")}
    expressions = {**EXPRESSIONS, "candidate": CANDIDATE}
    rows = rows.select("*", *[
        F.when(gates[k], F.regexp_extract_all("text", F.lit(e), F.lit(0))).otherwise(
            F.array().cast("array<string>")).alias(f"m_{k}") for k, e in expressions.items()])
    rows = rows.select("*", *[
        F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", e, -1), F.char_length)).otherwise(
            F.array().cast("array<int>")).alias(f"p_{k}") for k, e in expressions.items()])
    rows = rows.select("doc_id", "text_key", "text", *[_spans(f"m_{k}", f"p_{k}").alias(k) for k in expressions])
    base = [f"transform(filter({k}, x -> {VALID[k]}), x -> struct({n} AS kind, x.start AS start, x.end AS end, x.value AS value))"
            for n, k in enumerate(KINDS)]
    rows = rows.select("doc_id", "text_key", "text", "candidate", F.expr(f"concat({', '.join(base)})").alias("base"))
    free = F.expr("""transform(
        filter(candidate, c -> NOT exists(base, b -> b.start < c.end AND c.start < b.end)),
        c -> struct(CAST(NULL AS INT) AS kind, c.start AS start, c.end AS end, c.value AS value))""")
    rows = rows.select("doc_id", "text_key", "text", "base", F.concat("base", free).alias("instances"))
    n = CONTEXT_CHARS
    return rows.select(
        "doc_id", "text_key",
        F.expr("transform(base, x -> struct(x.start AS start, x.kind AS kind, x.end AS end))").alias("base"),
        F.expr(f"""transform(instances, x -> struct(x.kind AS kind, x.start AS start, x.end AS end,
            lower(x.value) AS value,
            substring(text, greatest(x.start - {n}, 0) + 1, least(x.start, {n})) AS left,
            substring(text, x.end + 1, {n}) AS right))""").alias("instances"))


def _patterns():
    """Lexical patterns of one instance: two words before it, and the words on both sides."""
    def word(text, expression, group):
        return F.regexp_replace(F.lower(F.regexp_extract(text, expression, group)), "[0-9]", "0")
    before, second = word(F.col("left"), r"(\S+)\s*$", 1), word(F.col("left"), r"(\S+)\s+\S+\s*$", 1)
    after = word(F.col("right"), r"^\s*(\S+)", 1)
    return F.filter(F.array(
        F.when((before != "") & (second != ""), F.concat_ws(" ", F.lit("2"), second, before)),
        F.when((before != "") & (after != ""), F.concat_ws(" ", F.lit("b"), before, after))),
        lambda p: p.isNotNull())


def _graph(scanned):
    """(pattern, value, kind) without repeats; kind is null for values not known yet."""
    rows = scanned.select(F.explode("instances").alias("i")).select("i.*")
    return rows.select(F.explode(_patterns()).alias("pattern"), "value", "kind").distinct()


def score_graph(links, rounds=ROUNDS, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE):
    """(value, kind, trust) of the values that good patterns extract and that are no seeds.

    A pattern's confidence for a kind is its trusted weight over all its values;
    it counts from min_support trusted values and min_confidence on. A value's
    trust is one minus the product of its patterns' doubts.
    """
    links = materialise(links, "pii-links")
    seeds = links.filter("kind is not null").select("value", "kind").distinct()
    pairs = materialise(links.select("pattern", "value").distinct(), "pii-pairs")
    width = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("width"))
    known = seeds.withColumn("trust", F.lit(1.0))
    found = None
    for _ in range(rounds):
        scores = pairs.join(known, "value").groupBy("pattern", "kind").agg(
            F.sum("trust").alias("weight"), F.count(F.lit(1)).alias("support"))
        scores = scores.join(width, "pattern").withColumn("confidence", F.col("weight") / F.col("width"))
        good = scores.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.99)))
        trusted = pairs.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(doubt))).alias("trust"))
        found = materialise(trusted.join(seeds.select("value").distinct(), "value", "left_anti"), "pii-trusted")
        known = seeds.withColumn("trust", F.lit(1.0)).unionByName(found)
    best = found.groupBy("value").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"),
                                      F.max("trust").alias("trust"))
    return best.filter(F.col("trust") >= min_confidence)


def find(docs, **options):
    """(doc_id, text_key, base, spans) for every row: arrays of (start, kind number, end), sorted.

    base holds the sound matches, spans those and what the contexts add; both
    count code points, end exclusive. Null text is empty and has no spans.
    Repeated rows have the same spans. Rows without doc_id are searched too. An
    empty table gives no rows; other columns are ignored.
    """
    scanned = materialise(scan(docs), "pii-scan")
    trusted = score_graph(_graph(scanned), **options)
    unknown = scanned.select("doc_id", "text_key", F.explode("instances").alias("i")).filter("i.kind is null").select(
        "doc_id", "text_key", F.col("i.value").alias("value"), F.col("i.start").alias("start"), F.col("i.end").alias("end"))
    more = unknown.join(trusted.select("value", "kind"), "value").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "kind", "end")).alias("more")).select(
            F.col("doc_id").alias("more_id"), F.col("text_key").alias("more_key"), "more")
    joined = scanned.join(
        more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")), "left")
    return joined.select("doc_id", "text_key", F.array_sort("base").alias("base"),
                         F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(joined.schema["base"].dataType)))
                                      ).alias("spans"))


def listed(spans):
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs, **options):
    """The documents with every span replaced by its kind in brackets.

    Of spans that overlap, the later one stands for what it has beyond the others.
    All columns are kept; n_chars, where there is one, follows the new text.
    Texts without spans, null ones too, stay as they are; rows that repeat a doc_id are judged by
    their own texts. Texts are only shuffled if the spans are measured to be beyond the broadcast limit.
    """
    found = materialise(find(docs.select("doc_id", "text"), **options).filter(F.size("spans") > 0).select(
        "doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"]), "pii-spans")
    # Longer than any column of the documents, so it clashes with none.
    name = "_" * (1 + max(map(len, docs.columns)))
    found = found.select(*[F.col(c).alias(f"{name}{c}") for c in found.columns])
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{name}doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{name}text_key"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    spans = f"{name}spans"
    clean = F.expr(f"""CASE WHEN {spans} IS NULL THEN text ELSE aggregate({spans}, struct(0 AS pos, '' AS done),
        (acc, s) -> CASE WHEN s.end <= acc.pos THEN acc ELSE struct(
            s.end AS pos,
            concat(acc.done, substring(text, acc.pos + 1, greatest(s.start - acc.pos, 0)), array({names})[s.kind]) AS done) END,
        acc -> concat(acc.done, substring(text, acc.pos + 1))) END""")
    rows = docs.join(F.broadcast(found) if fits_broadcast(found) else found, same, "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col(spans).isNotNull(), changed).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
