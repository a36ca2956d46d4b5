"""Repair of the structure of conversations: who speaks when, empty, repeated and cut off rows.

Rows are sorted in ranges, so a conversation of any length is cut in segments of bounded
size, in one or more tasks. A segment carries the costs of passing it between any two
states; those of a long conversation are chained backward over its segments (a few
numbers each), the states they begin in forward, and then every segment finds its own
edits. Conversations within one segment, which are nearly all, need none of this.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runledger.llm import turns
from runledger.session import materialise

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
ORDER_CHARS = 256

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_STATS = {"blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
          "first_turn": pa.int64(), "last_turn": pa.int64(), "n_turns": pa.int64(),
          "first_initial": pa.int32(), "last_initial": pa.int32()}
_PLACE = {"key": pa.string(), "conv_id": pa.int64(), "task": pa.int32(), "number": pa.int64(), "whole": pa.bool_()}
SEGMENT = pa.schema({**_PLACE, **_STATS, "kinds": pa.binary(), "copies": pa.list_(pa.int64()),
                     "passage": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())})
REPAIRED = pa.schema({**_PLACE, **_STATS, "cost": pa.int64(), "audit": pa.string(),
                      "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())})
REPORT = pa.schema({"conv_id": pa.int64(), "gaps": pa.int64(), **{c: pa.int64() for c in COUNTS},
                    "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()})
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary",
        pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def _ddl(schema):
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def damage(conversations):
    """Rows with the faults that crc32 of `conv_id:turn` modulo 20 names, and the number of their copies.

    0 drops a row (no copies; it still tells that its conversation is there), 1 empties its text, 2 takes the
    marks `.!?` out, 3 repeats it, 4 makes it the user's. Nulls are one blank in the hashed text, role and text.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def _folded(rows):
    """Equal rows as one row with a count, so that they are never in one task, and whether it is the first of its text.

    The first turn of a role and text is found by a combined minimum and joined back by the
    whole row's key, so a text that a third of all rows share stays spread.
    """
    keyed = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn_key"),
        F.coalesce("role", F.lit("")).alias("role"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"),
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.greatest("copies", F.lit(0)).alias("copies"))
    names = ["key", "turn_key", "role", "text_key"]
    folded = keyed.groupBy(*names).agg(F.max("conv_id").alias("conv_id"), F.max("turn").alias("turn"),
                                       F.max("text").alias("text"), F.sum("copies").alias("copies"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "turn_key")).alias("f")
    firsts = keyed.filter("copies > 0").groupBy("key", "role", "text_key").agg(first).select(
        "key", F.col("f.turn_key").alias("turn_key"), "role", "text_key", F.lit(True).alias("first"))
    return folded.join(firsts.hint("merge"), names, "left")


def _kinds(folded):
    """Row kinds of `turns` beside the rows: initial, fault."""
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(
        F.startswith("role", F.lit("a")), 2).otherwise(3)
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(trimmed == "", "blank").when(F.col("first").isNull(), "duplicate")
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    return folded.select("key", "conv_id", "turn", "role", "text", "copies", initial.alias("initial"), fault.alias("fault"))


class _Open:
    """The segment that is being filled."""

    def __init__(self, key, conv_id, number, whole):
        self.row = {"key": key, "conv_id": conv_id, "number": number, "whole": whole, **dict.fromkeys(_STATS)}
        self.row |= dict.fromkeys([*COUNTS, "n_turns"], 0)
        self.kinds, self.copies, self.roles, self.texts, self.size = bytearray(), [], [], [], 0

    def add(self, turn, role, text, copies, initial, fault):
        row = self.row
        if not copies:
            return
        if fault:
            row[fault] += copies if fault != "truncated" else 1
        if fault not in ("blank", "duplicate"):
            row["duplicate"] += copies - 1
        row["illegal"] += copies - 1
        if row["first_initial"] is None:
            row["first_initial"] = initial
        else:
            row["illegal"] += not _legal(row["last_initial"], initial)
        row["last_initial"] = initial
        if turn is not None:
            row["n_turns"] += turn != row["last_turn"]
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
        self.kinds.append(turns.GONE if fault in ("blank", "duplicate") else
                          initial + turns.INITIALS * (fault == "truncated"))
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)

    def done(self, whole):
        passage = None if whole else turns.tables().passage(turns.blocks_of(self.kinds))
        return self.row | {"whole": whole, "task": TaskContext.get().partitionId(), "kinds": bytes(self.kinds), "copies": self.copies,
                           "passage": passage, "roles": self.roles, "texts": self.texts}


def _legal(first, second):
    """Whether two initials may follow each other: su, ua, au."""
    return (first, second) in ((0, 1), (1, 2), (2, 1))


def _batched(rows, schema, size=lambda row: 100 + sum(map(len, row["texts"]))):
    """Record batches of bounded size from dicts."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in batch.schema.names))


def segments(rows):
    """Sorted segments of conversations, written once.

    `rows` has conv_id, turn, role, text and copies. Order is by turn, nulls first, then role and
    text. A segment is `whole` when it is all of its conversation; the first and the last
    conversation of a task may go on in the next one and never count as whole.
    """
    def run(batches):
        def found():
            now, number = None, 0
            for key, conv_id, turn, role, text, copies, initial, fault in _rows(batches):
                if now is None or key != now.row["key"]:
                    if now is not None:
                        yield now.done(now.row["whole"])
                        number += 1
                    now = _Open(key, conv_id, number, now is not None)
                elif len(now.kinds) >= SEGMENT_ROWS or now.size >= SEGMENT_BYTES:
                    yield now.done(False)
                    number += 1
                    now = _Open(key, conv_id, number, False)
                now.add(turn, role, text, copies, initial, fault)
            if now is not None:
                yield now.done(False)
        yield from _batched(found(), SEGMENT)
    order = ["key", "turn", "role"]
    # Equal keys of the ranges stay in one task, so a prefix of the text orders like the text.
    ranged = _kinds(_folded(rows)).repartitionByRange(*order, F.left(F.col("text"), F.lit(ORDER_CHARS)))
    return materialise(ranged.sortWithinPartitions(*order, "text").mapInArrow(run, _ddl(SEGMENT)), "segments")


def _streamed(rows, run, schema, backward=False):
    """Narrow rows of each key in the order of its segments, as one stream with nothing held but the last one."""
    place = [F.desc("task"), F.desc("number")] if backward else ["task", "number"]
    return rows.repartition("key").sortWithinPartitions("key", *place).mapInArrow(run, schema)


def _with_borders(parts):
    """Costs behind and the state before every segment of the conversations that go on in several."""
    def backward(batches):
        def found():
            last, ahead = None, None
            for key, task, number, passage in _rows(batches):
                ends = key != last
                if ends:
                    last, ahead = key, list(turns.END)
                yield {"task": task, "number": number, "ahead": ahead, "ends": ends}
                ahead = turns.before(passage, ahead)
        schema = pa.schema({"task": pa.int32(), "number": pa.int64(), "ahead": pa.list_(pa.int64()), "ends": pa.bool_()})
        yield from _batched(found(), schema, lambda row: 100)

    def ways(batches):
        table = turns.tables()

        def found():
            for key, task, number, kinds, ahead in _rows(batches):
                last, blocks = table.number[turns.lessened(ahead)[0]], turns.blocks_of(kinds)
                yield {"key": key, "task": task, "number": number,
                       "leads": [table.trace(blocks, last, state)[1] for state in range(4)]}
        schema = pa.schema({"key": pa.string(), "task": pa.int32(), "number": pa.int64(), "leads": pa.list_(pa.int64())})
        yield from _batched(found(), schema, lambda row: 100)

    def forward(batches):
        def found():
            last, state = None, turns.START
            for key, task, number, leads in _rows(batches):
                if key != last:
                    last, state = key, turns.START
                yield {"task": task, "number": number, "state": state}
                state = leads[state]
        yield from _batched(found(), pa.schema({"task": pa.int32(), "number": pa.int64(), "state": pa.int32()}), lambda row: 100)

    place = ["task", "number"]
    ahead = materialise(_streamed(parts.select("key", *place, "passage"), backward, "task int, number long, ahead array<long>, ends boolean", True), "ahead")
    leads = parts.select("key", *place, "kinds").join(ahead.drop("ends"), place).select("key", *place, "kinds", "ahead").mapInArrow(
        ways, "key string, task int, number long, leads array<long>")
    states = materialise(_streamed(leads, forward, "task int, number long, state int"), "states")
    return parts.join(ahead, place).join(states, place)


def _edit(batches):
    """Edits of each segment: repaired rows, audit and cost."""
    table = turns.tables()
    names = [*_PLACE, *_STATS]

    def found():
        for *given, kinds, copies, roles, texts, ahead, state, ends in _rows(batches):
            edits, state = table.trace(turns.blocks_of(kinds), table.number[turns.lessened(ahead)[0]], state)
            letters, new_roles, new_texts, cost = [], [], [], 0

            def insert(spoken):
                letters.append("I")
                new_roles.append(spoken)
                new_texts.append("")
                return turns.INSERT
            for kind, n, role, text, row in zip(kinds, copies, roles, texts, edits):
                for letter, spoken in row:
                    if letter == "I":
                        cost += insert(spoken)
                        continue
                    letters.append(letter)
                    if letter == "D":
                        cost += turns.DELETE
                    else:
                        cost += (turns.REROLE if letter == "R" else turns.KEEP) + turns.BROKEN * (kind >= turns.INITIALS)
                        new_roles.append(spoken or role)
                        new_texts.append(text)
                letters.append("D" * (n - 1))
                cost += turns.DELETE * (n - 1)
            if ends:
                cost += sum(insert(spoken) for _, spoken in table.closing(state))
            yield dict(zip(names, given)) | {"cost": cost, "audit": "".join(letters), "roles": new_roles, "texts": new_texts}
    yield from _batched(found(), REPAIRED)


def repair(rows):
    """Repaired segments of conversations: place, counts of faults, cost, audit, and the roles and texts that stay.

    `rows` has conv_id, turn, role, text and copies (how often a row stands there; with 0
    it only tells that the conversation exists); other columns are not read. Rows go by turn, nulls first;
    rows of one turn by role, then text, so equal rows are adjacent. A row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated (no `.!?` at its end). Blank
    and repeated rows are deleted, truncated ones cost more unless deleted. The audit has the edits'
    letters, the ASCII-least of the cheapest. A null role or text counts as an empty one, and an empty role has no
    initial that could stay. A null conv_id is a conversation like any other. No rows give no segments.
    """
    cut = segments(rows)
    names = [*_PLACE, *_STATS, "kinds", "copies", "roles", "texts"]
    ahead = F.array(*[F.lit(c) for c in turns.END]).cast("array<long>")
    whole = cut.filter("whole").select(*names, ahead.alias("ahead"), F.lit(turns.START).alias("state"), F.lit(True).alias("ends"))
    parts = _with_borders(cut.filter("not whole")).select(*names, "ahead", "state", "ends")
    return whole.unionByName(parts).mapInArrow(_edit, _ddl(REPAIRED))


def repaired_turns(repaired):
    """The rows that stay: conv_id, place (task, number, at) and role and text, in that order."""
    return repaired.select("conv_id", "task", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn")).select(
        "conv_id", "task", "number", "at", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


class _Summary:
    """Counts and digest of a conversation, segment after segment; only letters and numbers are held."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.cost, self.audit = conv_id, dict.fromkeys(COUNTS, 0), 0, []
        self.first_turn = self.last_turn = self.last_initial = None
        self.n_turns, self.digest, self.any = 0, hashlib.sha256(), False

    def add(self, s):
        for name in COUNTS:
            self.counts[name] += s[name]
        if s["first_initial"] is not None:
            if self.last_initial is not None:
                self.counts["illegal"] += not _legal(self.last_initial, s["first_initial"])
            self.last_initial = s["last_initial"]
        if s["first_turn"] is not None:
            self.n_turns += s["n_turns"] - (s["first_turn"] == self.last_turn)
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]
        self.cost += s["cost"]
        self.audit.append(s["audit"])
        lines = "\n".join(f"{role}:{text}" for role, text in zip(s["roles"], s["texts"]))
        if s["roles"]:
            self.digest.update((("\n" if self.any else "") + lines).encode())
            self.any = True

    def row(self):
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        return {"conv_id": self.conv_id, "gaps": gaps if gaps < 1 << 63 else None, **self.counts, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _report(batches):
    def found():
        key, summary = None, None
        for row in _rows(batches):
            s = dict(zip(REPAIRED.names, row))
            if s["key"] != key:
                if summary is not None:
                    yield summary.row()
                key, summary = s["key"], _Summary(s["conv_id"])
            summary.add(s)
        if summary is not None:
            yield summary.row()
    yield from _batched(found(), REPORT, lambda row: 200 + len(row["audit"]))


def report(repaired):
    """One row per conversation: gaps, faults, cost, audit and the SHA-256 of the repaired `role:text` lines.

    Gaps beyond the range of a long are null. Conversations of one segment are not shuffled; of the others, the segments
    pass through the digest one after the other.
    """
    whole = repaired.filter("whole").mapInArrow(_report, _ddl(REPORT))
    return whole.unionByName(_streamed(repaired.filter("not whole"), _report, _ddl(REPORT)))
