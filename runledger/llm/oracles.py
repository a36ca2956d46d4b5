"""The operators that SQL can express, over the same whole tables."""

CONTAMINATION = r"""
with texts as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
),
tests as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where item_id is not null
),
item_windows as (
  select distinct item_id, words[first:first + 12] as terms
  from (select item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as first
        from tests where len(words) > 0)
),
windows as (
  select row_number() over () as window_no, terms, len(terms) as size
  from (select distinct terms from item_windows)
),
window_items as (
  select window_no, item_id from item_windows join windows using (terms)
),
places as (
  select row_no, unnest(words) as word, generate_subscripts(words, 1) as pos from texts
),
spans as (
  select row_no, words, size, unnest(range(1, len(words) - size + 2)) as pos
  from texts, (select distinct size from windows) where len(words) >= size
),
exact as (
  select s.row_no, s.pos, w.window_no, w.size
  from spans s join windows w on s.words[s.pos:s.pos + s.size - 1] = w.terms
),
hits as (
  select row_no, count(*) as n_hit
  from (select distinct row_no, unnest(range(pos, pos + size)) as pos from exact)
  group by row_no
),
exact_items as (
  select distinct row_no, item_id from exact join window_items using (window_no)
),
counted as (
  select word, count(*) as n from places group by word
),
ranked as (
  select window_no, place, word, row_number() over (
    partition by window_no order by coalesce(n, 0), place) as rank
  from (select window_no, unnest(terms) as word, generate_subscripts(terms, 1) - 1 as place from windows)
    left join counted using (word)
),
candidates as (
  select p.row_no, r.window_no, p.pos - r.place as first
  from ranked r join places p on p.word = r.word where r.rank = 1
),
around as (
  select row_no, word, pos + shift as pos
  from places, (select unnest([-2, -1, 0, 1, 2]) as shift)
  group by all
),
near as (
  select c.row_no, c.window_no, c.first
  from candidates c
    join ranked r on r.window_no = c.window_no and r.rank > 1
    join around a on a.row_no = c.row_no and a.word = r.word and a.pos = c.first + r.place
  group by c.row_no, c.window_no, c.first, c.window_no
  having count(*) + 1 = (select max(w.size) from windows w where w.window_no = c.window_no)
),
near_items as (
  select distinct row_no, item_id from near join window_items using (window_no)
  except select row_no, item_id from exact_items
),
listed as (
  select row_no, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from exact_items group by row_no
),
near_counts as (
  select row_no, count(*) as n_near_items from near_items group by row_no
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated,
  cast(coalesce(n_near_items, 0) as bigint) as n_near_items
from texts left join hits using (row_no) left join listed using (row_no) left join near_counts using (row_no)
"""

# Bytes are pairs of hexadecimal digits. A block has the strings that start in its first 256 bytes
# and holds all their bytes, so the blocks cover every string once.
REPEATS = """
with texts as (
  select row_number() over () as row_no, doc_id, hex(encode(coalesce(text, ''))) as digits
  from documents
),
blocks as (
  select row_no, doc_id, low, substr(digits, 2 * low + 1, 610) as block
  from (select row_no, doc_id, digits, unnest(range(0, length(digits) // 2, 256)) as low from texts)
),
strings as (
  select row_no, doc_id, low + inside as pos, md5(substr(block, 2 * inside + 1, 100)) as string
  from (select row_no, doc_id, low, block, unnest(range(0, least(length(block) // 2 - 49, 256))) as inside
        from blocks where length(block) >= 100)
),
lowest as (
  select string, min(doc_id) as first_id from strings group by string having min(doc_id) < max(doc_id)
),
starts as (
  select row_no, pos, lag(pos) over (partition by row_no order by pos) as before
  from strings join lowest using (string) where doc_id > first_id
),
numbered as (
  select row_no, pos, sum(case when before is null or pos > before + 50 then 1 else 0 end) over (
    partition by row_no order by pos) as run
  from starts
),
runs as (
  select row_no, run, min(pos) as first, max(pos) + 50 as last from numbered group by row_no, run
),
gaps as (
  select row_no, run, first, last, coalesce(lag(last) over (partition by row_no order by run), 0) as from_byte
  from runs
),
kept as (
  select row_no, count(*) as n_spans, sum(last - first) as n_removed,
    string_agg(substr(digits, 2 * from_byte + 1, 2 * (first - from_byte)), '' order by run)
      || substr(any_value(digits), 2 * max(last) + 1) as rest
  from gaps join texts using (row_no) group by row_no
)
select doc_id, cast(length(digits) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(rest, digits))) as kept_sha256
from texts left join kept using (row_no)
"""

# Base 32 digit i of a digest is in its hexadecimal digits 5 * i // 4 and the next one.
ARCHIVES = """
with payloads as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest from pages
),
placed as (
  select *, case when row_number() over (partition by payload order by page_id nulls last) > 1
    then min(page_id) over (partition by payload) end as refers_to
  from payloads
)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((
    ((instr('0123456789abcdef', substr(digest, 5 * i // 4 + 1, 1)) - 1) * 16
      + instr('0123456789abcdef', substr(digest, 5 * i // 4 + 2, 1)) - 1) >> (3 - i % 4)) & 31) as bigint), 1)
    for i in range(0, 32)], '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from placed
"""

URLS = r"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
),
rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
numbered as (select row_number() over () as row_no, * from parts),
best as (
  select row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(verdict, length(rule_host || rule_path)) as verdict
  from numbered join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by row_no
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from numbered left join best using (row_no)
"""

INTERACTION = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
firsts as (
  select text, min(doc_id) as first_id from texts group by text
),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(words) < 200 then ['A'] else [] end)
    || (case when 100 * len(list_distinct(words)) < 50 * len(words) then ['B'] else [] end)
    || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then ['C'] else [] end)
    || (case when regexp_matches(text, '[#$%&*|]') then ['D'] else [] end)
    || (case when doc_id > first_id then ['E'] else [] end) as fails
  from texts join firsts using (text) left join marks using (doc_id)
),
combos as (
  select part, good, toxic, fails, count(*) as n from failed group by all
),
letters(letter) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select [a.letter, b.letter, c.letter, d.letter, e.letter] as letters
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
),
steps as (
  select array_to_string(letters, '') as filter_order, step, letters[step] as own, letters[1:step - 1] as before
  from orders, (select unnest(range(1, 6)) as step)
),
counted as (
  select part, filter_order, step, own,
    sum(case when not list_contains(fails, own) and not list_has_any(fails, before) then n else 0 end) as kept,
    sum(case when list_contains(fails, own) and not list_has_any(fails, before) then n else 0 end) as removed,
    sum(case when list_contains(fails, own) and list_has_any(fails, before) then n else 0 end) as redundant,
    sum(case when fails = [own] then n else 0 end) as unique_fails,
    sum(case when list_contains(fails, own) and not list_has_any(fails, before) then n * good else 0 end) as good_lost,
    sum(case when list_contains(fails, own) and not list_has_any(fails, before) then n * toxic else 0 end) as toxic_lost
  from combos, steps group by all
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from counted
"""

_FAR = 1 << 40


def _edit(state, cost, letter, line="''"):
    """A state (cost, audit, text) after one more edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _least(*states):
    return f"list_min([{', '.join(states)}])"


def _insertions(found):
    """Columns s0 to s3 with rows inserted before the next one; three insertions can follow each other."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    for _ in range(2):
        found = (f"select * replace ({_least('s2', *(_edit(s, 5, 'I', user) for s in ('s0', 's1', 's3')))} as s2, "
                 f"{_least('s3', _edit('s2', 5, 'I', assistant))} as s3) from ({found})")
    return found


def _conversations():
    far = f"{{'c': {_FAR}, 'a': '', 't': ''}}"
    line = "chr(10) || role || ':' || text"
    rerole = {who: f"chr(10) || '{who}:' || text" for who in ("user", "assistant")}

    def kept(state, initial):
        return f"case when must_go or initial <> '{initial}' then {far} else {_edit(state, 'extra', 'K', line)} end"

    def changed(state, role):
        return f"case when must_go then {far} else {_edit(state, '1 + extra', 'R', rerole[role])} end"
    speak = [f(s, x) for s in ("w.s0", "w.s1", "w.s3") for f, x in ((kept, "u"), (changed, "user"))]
    step = f"""
    select w.key, r.place, {_edit('w.s0', 2, 'D')} as s0, {_least(_edit('w.s1', 2, 'D'), kept('w.s0', 's'))} as s1,
      {_least(_edit('w.s2', 2, 'D'), *speak)} as s2,
      {_least(_edit('w.s3', 2, 'D'), kept('w.s2', 'a'), changed('w.s2', 'assistant'))} as s3
    from walk w join numbered r on r.key = w.key and r.place = w.place + 1"""
    start = f"select key, cast(0 as bigint) as place, {{'c': cast(0 as bigint), 'a': '', 't': ''}} as s0, {far} as s1, {far} as s2, {far} as s3 from ids"
    return rf"""
with recursive ids as (
  select distinct conv_id, coalesce(cast(conv_id as varchar), '') as key from conversations
),
spaced as (
  select conv_id, coalesce(cast(conv_id as varchar), '') as key, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place_key
  from conversations
),
hashed as (
  select *, xor(4294967295, list_reduce(
      list_prepend(cast(4294967295 as bigint), list_transform(string_split(place_key, ''), lambda c: cast(ascii(c) as bigint))),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, unused: xor(x >> 1, 3988292384 * (x & 1))))) % 20 as fate
  from spaced
),
damaged as (
  select conv_id, key, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy
  from hashed where fate <> 0
),
ordered as (
  select *, row_number() over (partition by key order by turn nulls first, role, text, copy) as place,
    rtrim(text, E' 	
') as bare
  from damaged
),
judged as (
  select *, left(role, 1) as initial, row_number() over (partition by key, role, text order by place) > 1 as seen,
    lag(left(role, 1)) over (partition by key order by place) as before
  from ordered
),
numbered as (
  select *, bare = '' or seen as must_go, bare = '' as blank, bare <> '' and seen as duplicate,
    bare <> '' and not seen and right(bare, 1) not in ('.', '!', '?') as truncated,
    case when right(bare, 1) not in ('.', '!', '?') then 5 else 0 end as extra,
    place > 1 and before || initial not in ('su', 'ua', 'au') as illegal
  from judged
),
counted as (
  select key, count(*) as n, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps,
    count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (illegal) as illegal
  from numbered group by key
),
walk as (
  {_insertions(start)}
  union all
  {_insertions(step)}
),
ends as (
  select key, place, {_least('s0', 's3')} as best from walk
)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
  sha256(best.t[2:]) as repaired_sha256
from ids left join counted using (key) join ends on ends.key = ids.key and ends.place = coalesce(n, 0)
"""


ORACLES = {"op3_decontamination": CONTAMINATION, "op4_suffixes": REPEATS, "op5_warc": ARCHIVES, "op11_urls": URLS, "op12_conversations": _conversations(),
           "op13_interaction": INTERACTION}
