"""Page text, document numbers and the link graph."""

from pyspark.sql import functions as F

from runledger.operators.joins import hot_keys
from runledger.operators.ordering import with_ordinal
from runledger.session import BROADCAST_LIMIT, bucketed, fits_broadcast, materialise, row_size, shuffle_partitions, tasks_for

NEIGHBOURS_PER_ROW = 100_000
EDGES_PER_TASK = 500_000
TABLES_KEPT = 6
FEW_NODES = 256
HREF = r'href="([^"]+)"'
# Targets of all links, also of those in the labels and captions of others.
WIKI_LINK = r"\[\[([^\[\]|#]+)(?=[|#\]])"

_HTML = [
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]*>", " "),
]
_COMMENT = (r"(?s)<!--.*?-->", " ")
_WIKI = [
    (r"\[https?://[^\s\]]+ ?([^\]]*)\]", "$1"),
    (r"'{2,}", ""),
    (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
    (r"<[^>]*>", " "),
]
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
             ("&amp;", "&")]


# A reference's tag up to its end, a `>` outside quotes; one that ends in `/>` has no text.
_REF = r"""(?i:<ref(?:\s(?:"[^"]*"|'[^']*'|[^>"'])*)?)"""
_FILES = "(?:File|Image|Category):"
# Brackets of wiki text: opening and closing expression, and the literal forms of marks without a partner.
# A table's end is not the end of a template whose last argument is empty.
_BRACKETS = [
    (r"\{\{", r"\}\}", "{{", "}}"),
    (r"\{\|", r"\|\}(?!\}(?!\}))", "{|", "|}"),
    (r"\[\[", r"\]\]", "[[", "]]"),
    (rf"{_REF}(?<!/)>", r"(?i:</ref\s*>)", " ", " "),
]
# Noncharacters, which no text may hold, stand for the marks: opening and closing by kind.
_OPEN = [chr(0xFDD0 + 2 * kind) for kind in range(len(_BRACKETS))]
_CLOSE = [chr(0xFDD1 + 2 * kind) for kind in range(len(_BRACKETS))]
_MARKS = f"[{_OPEN[0]}-{_CLOSE[-1]}]"
_BETWEEN = f"[^{_OPEN[0]}-{_CLOSE[-1]}]*"
_LINK_OPEN, _LINK_CLOSE = _OPEN[2], _CLOSE[2]
# What an innermost pair becomes: a link its label or target, all others a blank.
_INNERMOST = [
    *[(f"{o}{_BETWEEN}{c}", " ") for o, c in zip(_OPEN, _CLOSE) if o != _LINK_OPEN],
    (f"{_LINK_OPEN}{_FILES}{_BETWEEN}{_LINK_CLOSE}", " "),
    (f"{_LINK_OPEN}(?!{_FILES})(?:[^|{_OPEN[0]}-{_CLOSE[-1]}]*\\|)?({_BETWEEN}){_LINK_CLOSE}", "$1"),
]


def _replaced(text, rules):
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _partners(marks):
    """(positions of marks without a partner, depth of nesting) from marks (kind, opens, at) in order.

    A stack of open marks with their kinds. A closing mark takes the nearest open one of
    its kind; open marks above that one have no partner.
    """
    start = F.struct(F.array().cast("array<struct<kind:int,at:int>>").alias("stack"),
                     F.array().cast("array<int>").alias("lost"), F.lit(0).alias("depth"))

    def read(state, mark):
        stack, lost, depth = state["stack"], state["lost"], state["depth"]
        pushed = F.concat(stack, F.array(F.struct(mark["kind"].alias("kind"), mark["at"].alias("at"))))
        above = F.array_position(F.reverse(F.transform(stack, lambda s: s["kind"])), mark["kind"]).cast("int")
        left = F.size(stack) - above
        over = F.transform(F.slice(stack, left + 2, above - 1), lambda s: s["at"])
        new = lambda stack, lost, depth: F.struct(stack.alias("stack"), lost.alias("lost"), depth.alias("depth"))
        return (F.when(mark["opens"], new(pushed, lost, F.greatest(depth, F.size(pushed))))
                .when(above == 0, new(stack, F.concat(lost, F.array(mark["at"])), depth))
                .otherwise(new(F.slice(stack, F.lit(1), left), F.concat(lost, over), depth)))

    def finish(state):
        rest = F.transform(state["stack"], lambda s: s["at"])
        return F.struct(F.concat(state["lost"], rest).alias("lost"), state["depth"].alias("depth"))
    return F.aggregate(marks, start, read, finish)


def _without_brackets(text):
    """Text whose templates, tables and references became blanks and whose links became their labels.

    Brackets of all kinds may stand in each other to any depth. Marks without a partner stay in
    the text, or become a blank if they are tags. Pairs are replaced from the innermost
    outward, in as many passes over the text as brackets are nested.
    """
    rules = [(bracket[0], o) for bracket, o in zip(_BRACKETS, _OPEN)] + [(bracket[1], c) for bracket, c in zip(_BRACKETS, _CLOSE)]
    # Ends of tables first: of three braces behind a bar, one is the table's.
    marked = _replaced(text, sorted(rules, key=lambda rule: rule[1] != _CLOSE[1]))
    pieces = F.split(marked, f"(?<={_MARKS})|(?={_MARKS})")
    placed = F.transform(pieces, lambda p, i: F.struct((F.ascii(p) - 0xFDD0).alias("code"), F.length(p).alias("size"), i.alias("at")))
    marks = F.transform(
        F.filter(placed, lambda m: (m["size"] == 1) & m["code"].between(0, 2 * len(_BRACKETS) - 1)),
        lambda m: F.struct(F.shiftright(m["code"], 1).alias("kind"), (m["code"] % 2 == 0).alias("opens"), m["at"].alias("at")))

    def literal(piece):
        written = piece
        for bracket, o, c in zip(_BRACKETS, _OPEN, _CLOSE):
            written = F.when(piece == o, bracket[2]).when(piece == c, bracket[3]).otherwise(written)
        return written

    def resolved(found):
        paired = F.array_join(F.transform(found["pieces"], lambda p, i: F.when(
            F.array_contains(found["partners"]["lost"], i), literal(p)).otherwise(p)), "")
        passes = F.filter(F.sequence(F.lit(0), found["partners"]["depth"]), lambda n: n > 0)
        return F.aggregate(passes, paired, lambda t, _: _replaced(t, _INNERMOST))
    # An array of one, so that pieces and partners are made once for all their uses.
    once = F.transform(F.array(F.struct(pieces.alias("pieces"), _partners(marks).alias("partners"))), resolved)
    return F.when(marked.rlike(_MARKS), F.get(once, F.lit(0))).otherwise(text)


def plain_text(pages, markup="wiki", column="text"):
    """Readable text of every page; `markup` is wiki or html."""
    if markup not in ("wiki", "html"):
        raise ValueError("markup must be wiki or html")
    text = F.col(column)
    if markup == "wiki":
        text = _without_brackets(_replaced(text, [_COMMENT, (f"{_REF}(?<=/)>", " ")]))
    text = _replaced(text, _HTML if markup == "html" else _WIKI)
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "))
    return pages.withColumn("plain", text)


def doc_numbers(pages, key="page_id"):
    """Dense document numbers from 1 in key order; pages with one key share its number."""
    return with_ordinal(pages.select(key).distinct(), [key], name="docno", collapse_copies=False)


def repack(pages, docnos, key="page_id"):
    """Pages keyed by their document number."""
    return pages.join(docnos, key).select("docno", *[c for c in pages.columns if c != key])


def link_edges(pages, pattern, source, column="text"):
    """Distinct links from every page."""
    targets = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
    return pages.select(F.col(source).alias("src"), F.explode(targets).alias("dst")).distinct()


def distinct_rows(rows, count, salts=16):
    """Different rows out of about `count`, by as many tasks as these take.

    A task that reads a well-compressed file would hold far more rows in its hash map than
    the file's bytes tell. So rows are dealt first, copies of one row over `salts` tasks, and
    what is left of each share meets in one task.
    """
    n = tasks_for(rows.sparkSession, count, EDGES_PER_TASK)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")
    shares = rows.select("*", salt).repartition(n, *rows.columns, "_salt").distinct().select(*rows.columns)
    return shares.repartition(n, *rows.columns).distinct()


def adjacency(edges, neighbours_per_row=NEIGHBOURS_PER_ROW, limit=BROADCAST_LIMIT, salts=64):
    """Sorted distinct neighbours of every node, as (node, part, neighbours).

    A node with more neighbours than fit one row gets several parts, each with
    the neighbours of one hash share, so no row or task holds a whole hub. All
    others have the single part 0. Edges are written and counted, so that tasks
    hold a bounded number of them, and the different ones written once more, as they
    are read for the degrees and for the lists. The hubs, at most one per
    `neighbours_per_row` edges, are broadcast when their measured size is within
    `limit`; beyond it every edge joins on its node and a salt, so that a hub's
    edges never meet in one task.
    """
    every_edge = materialise(edges.select("src", "dst"), "every-edge")
    count = every_edge.count()
    links = materialise(distinct_rows(every_edge, count), "edges")
    hubs = materialise(
        links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).filter(
            F.col("degree") > neighbours_per_row), "hubs")
    if fits_broadcast(hubs, limit):
        marked = links.join(F.broadcast(hubs), "src", "left")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        salt = F.pmod(F.xxhash64("dst", F.lit("salt")), F.lit(salts)).cast("int")
        marked = links.withColumn("salt", salt).hint("merge").join(
            hubs.withColumn("salt", every), ["src", "salt"], "left")
    parts = F.ceil(F.col("degree") / neighbours_per_row)
    part = F.when(F.col("degree").isNotNull(), F.pmod(F.xxhash64("dst"), parts)).otherwise(0)
    placed = marked.select(F.col("src").alias("node"), part.cast("long").alias("part"), "dst")
    n = tasks_for(edges.sparkSession, count, EDGES_PER_TASK)
    return placed.repartition(n, "node", "part").groupBy("node", "part").agg(
        F.sort_array(F.collect_list("dst")).alias("neighbours"))


def bfs_encode(lists, source):
    """Distance 0 for the source and NULL, not reached, for all others."""
    return lists.withColumn("dist", F.when(F.col("node") == F.lit(source), 0))


def _kept(rows, size, limit, label):
    """Known nodes as a table: in buckets if they are too large to be broadcast."""
    return (bucketed(rows, "node", label) if size > limit else materialise(rows, label)), size


def _compacted(tables, limit):
    """(table, bytes) pairs, newest last, with the newest ones of like size written as one.

    A row is written again only with at least half as many others, so the number
    of tables and the rewriting grow with the logarithm of the rows. Small tables that
    are together beyond the limit become one table in buckets.
    """
    small = [pair for pair in tables if pair[1] <= limit]
    total = sum(size for _, size in small)
    if total > limit:
        return [*(pair for pair in tables if pair[1] > limit), _kept(_union(small), total, limit, "bfs-known")]
    if len(tables) <= TABLES_KEPT:
        return tables
    first = len(tables) - 1
    size = tables[first][1]
    while first > 0 and tables[first - 1][1] < 2 * size:
        first -= 1
        size += tables[first][1]
    if first == len(tables) - 1:
        return tables
    return [*tables[:first], _kept(_union(tables[first:]), size, limit, "bfs-known")]


def _union(tables):
    known = tables[0][0]
    for table, _ in tables[1:]:
        known = known.unionByName(table)
    return known


def _without(fresh, known, limit):
    """Fresh nodes that are in none of the tables: small ones are broadcast together, large ones keep their buckets."""
    small = [pair for pair in known if pair[1] <= limit]
    if small:
        side = _union(small).select("node")
        fresh = fresh.join(F.broadcast(side), "node", "left_anti")
    for table, size in known:
        if size > limit:
            fresh = fresh.join(table.select("node").hint("merge"), "node", "left_anti")
    return fresh


def _values(rows, column):
    """The values of a column of few rows."""
    return [r[0] for r in rows.select(column).distinct().collect()]


class _Links:
    """Edges for search rounds: bucketed by their source, those of hubs apart and spread."""

    def __init__(self, edges, limit, few, hubs):
        spark, pairs = edges.sparkSession, materialise(edges.select("src", "dst").filter("src is not null and dst is not null"), "bfs-all")
        self.limit, self.few = limit, few
        found = hot_keys(pairs, "src", hubs or shuffle_partitions(spark))
        self.hubs = F.array(*[F.lit(k) for k in found]).cast(f"array<{pairs.schema['src'].dataType.simpleString()}>")
        is_hub = F.array_contains(self.hubs, F.col("src"))
        self.plain = bucketed(pairs.filter(~is_hub) if found else pairs, "src", "bfs-edges")
        self.of_hubs = materialise(pairs.filter(is_hub), "bfs-hubs") if found else None

    def reached(self, newest, rows, size):
        """Ends of the edges that start in the newest nodes, each once."""
        side = newest.select(F.col("node").alias("src"))
        if rows <= self.few:
            found = self.plain.filter(F.col("src").isin(_values(side, "src")))
        elif size <= self.limit:
            found = self.plain.join(F.broadcast(side), "src", "left_semi")
        else:
            found = self.plain.join(side.hint("merge"), "src", "left_semi")
        if self.of_hubs is not None:
            met = _values(side.filter(F.array_contains(self.hubs, F.col("src"))), "src")
            if met:
                found = found.unionByName(self.of_hubs.filter(F.col("src").isin(met)))
        return found.select(F.col("dst").alias("node")).distinct()


def bfs(edges, source, max_iter=None, limit=BROADCAST_LIMIT, few=FEW_NODES, hubs=None):
    """Hops from the source to every node it reaches.

    Edges are written once, in buckets by source. A round asks for the edges of its newest
    nodes: by value if there are at most `few`, so that only their buckets are read; by
    broadcast while they are measured to be within `limit`; else by a merge join, whose sides
    have the same buckets. The nodes reached are shuffled once, and those that are known are
    dropped: known nodes that are together within `limit` are broadcast, all others stand in
    the buckets that the nodes reached were shuffled to. So no round shuffles edges or
    more than `limit` of known nodes. Every few rounds known nodes are compacted, so plans stay
    small on long paths. The rounds' tables cut the lineage.

    Hubs, the sources of more than one edge in `hubs` (the number of shuffle partitions if
    not given), would fill a bucket: their edges stand apart, spread over all tasks, and are
    read whole when a round has one of the hubs, a list of at most 4 * `hubs`. Repeated
    edges do no harm; those with a null end lead nowhere; a null or unknown source reaches itself only.
    """
    spark = edges.sparkSession
    links = _Links(edges, limit, few, hubs)
    kind = edges.schema["src"].dataType
    newest = materialise(spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0).alias("dist")), "bfs-0")
    (rows, size), step = row_size(newest), 0
    if size > limit:
        newest, _ = _kept(newest, size, limit, "bfs-0")
    known = [(newest, size)]
    while rows > 0 and (max_iter is None or step < max_iter):
        step += 1
        fresh = _without(links.reached(newest, rows, size), known, limit)
        newest = materialise(fresh.withColumn("dist", F.lit(step)), f"bfs-{step}")
        rows, size = row_size(newest)
        if rows > 0:
            if size > limit:
                newest, _ = _kept(newest, size, limit, f"bfs-{step}")
            known = _compacted([*known, (newest, size)], limit)
    return _union(known)
