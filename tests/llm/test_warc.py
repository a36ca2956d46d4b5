"""Archives written and read back."""

import base64
import gzip
import hashlib
import random

import pyarrow.fs

from runledger.llm import warc
from runledger.session import scratch_path

SCHEMA = "page_id long, url string, html string, shard string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    first, out = {}, []
    for page_id, _, html, _ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    copies = [html or "" for _, _, html, _ in rows]
    seen = set()
    for page_id, url, html, _ in rows:
        html = html or ""
        target = first.get(html) if copies.count(html) > 1 else None
        revisit = target is not None and (target != page_id or (page_id, html) in seen)
        seen.add((page_id, html))
        out.append((page_id, len(html.encode()), digest(html), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


def roundtrip(spark, rows, **options):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, **options)
    return folder, manifest.collect(), warc.read_archives(spark, folder).collect()


def table(n, seed=1):
    rng = random.Random(seed)
    bodies = [f"<p>{rng.random()}é</p>" * rng.randint(0, 60) for _ in range(n // 3)] + [None, ""]
    rows = [(i * 7 % 1009, f"http://x/{i}", rng.choice(bodies), "clash") for i in range(n)]
    return [*rows, rows[5], rows[5], (None, None, "no id", ""), (None, "u\r\nX: y", rows[0][2], ""), (2000, None, "z" * 3_000_000, "")]


def test_roundtrip(spark):
    rows = table(200)
    folder, manifest, found = roundtrip(spark, rows, records_per_shard=30, roll_bytes=2000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute(rows)
    payloads = {digest(h): (h or "").encode() for _, _, h, _ in rows}
    assert all(r.payload == payloads[r.payload_digest] for r in found if r.record_type == "response")
    assert len(manifest) > 8 and sum(m.records for m in manifest) == len(rows)


def test_equal_input_gives_equal_bytes(spark):
    rows = table(120)
    _, first, _ = roundtrip(spark, rows, records_per_shard=25)
    _, second, _ = roundtrip(spark, list(reversed(rows)), records_per_shard=25)
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_files_are_gzip_members_in_page_order(spark):
    folder, manifest, _ = roundtrip(spark, [(i, "u", f"body {i}", "") for i in range(50)], records_per_shard=20)
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    ids = []
    for m in sorted(manifest):
        text = gzip.decompress(store.open_input_stream(f"{path}/data/{m.file}").read()).decode()
        ids += [int(line.split()[1]) for line in text.split("\r\n") if line.startswith("Page-ID:")]
    assert ids == list(range(50))


def test_leftovers_of_lost_attempts_are_not_read(spark):
    folder, _, found = roundtrip(spark, [(1, "u", "a", ""), (2, "u", "b", "")])
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    for place in ("_temporary/9-shard-000000-00000.warc.gz", "data/shard-000099-00000.warc.gz"):
        with store.open_output_stream(f"{path}/{place}") as out:
            out.write(b"half a rec")
    assert warc.read_archives(spark, folder).count() == len(found) == 2


def test_short_payloads_may_stay_responses(spark):
    rows = [(1, "u", "tiny", ""), (2, "u", "tiny", ""), (3, "u", "long enough", ""), (4, "u", "long enough", "")]
    _, _, found = roundtrip(spark, rows, min_revisit_bytes=8)
    assert {r.page_id: (r.record_type, r.refers_to) for r in found} == {
        1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty(spark):
    _, manifest, found = roundtrip(spark, [])
    assert manifest == [] and found == []
