"""The same answers in plain SQL, from the columns and never from rendered text."""

JOB = "'202401010000_' || format('{:04d}', g % 10)"
ATTEMPT = f"'attempt_' || {JOB} || '_' || phase || '_' || format('{{:06d}}', g) || '_0'"


def _pad4(number):
    return f"format('{{:04d}}', {number})"


def _run(number):
    return f"'EXPT-' || {_pad4(number)}"


def _job(number):
    return f"'job_202401010000_' || {_pad4(number)}"


# One row per log line; n is the place of the line in its log.
LINES = f"""
lines as (
  select *, 'node-' || (g % 7) as host, {ATTEMPT} as attempt_id, 'job_' || {JOB} as job_id,
         row_number() over (partition by g order by event_id) as n
  from (select *, event_id // 12 as g,
               case when (event_id // 12) % 3 = 0 then 'r' else 'm' end as phase from events))"""

FACTS = LINES + """,
facts as (
  select host, attempt_id, job_id, phase,
         epoch(date_trunc('second', arg_max(ts, n)))::bigint
           - epoch(date_trunc('second', arg_min(ts, n)))::bigint as seconds,
         coalesce(bool_or(event_type = 'purchase') filter (n > 1), false) as bought,
         coalesce(bool_or(event_type = 'signup') filter (n > 1), false) as signed,
         coalesce(bool_or(event_type = 'view') filter (n > 1), false) as viewed,
         coalesce(bool_or(event_type = 'click') filter (n > 1), false) as clicked,
         coalesce(bool_or(event_type = 'error' and value < 10) filter (n > 1), false) as cleaned
  from lines group by all),
outcome as (
  select *, case when phase = 'm' then not cleaned and bought and signed and clicked
                 else viewed and (signed or bought) end as good
  from facts)"""

STATUS = "case when good then 'SUCCESSFUL' else 'FAILED|KILLED' end as status"



def _client(run):
    return f"""
client as (
  select *, {_run(run)} as expt_id, {_job(f'({run}) * 10 + event_id % 3')} as job_id
  from events)"""


CLIENT = _client("user_id")

JOB_IDS = CLIENT + """,
ids as (select distinct expt_id, job_id from client where event_type = 'click')"""

RUNS = """
runs as (
  select distinct user_id as run_order from events
  union all
  select distinct user_id + 1000000 from events where user_id % 10 = 0)"""

TIMES = """,
times as (
  select expt_id, job_id,
         min(epoch(date_trunc('second', ts))) filter (event_type = 'click') as a,
         max(epoch(date_trunc('second', ts))) filter (event_type = 'purchase') as b
  from client group by all),
job_times as (select expt_id, job_id, (b - a)::bigint as seconds from times where a is not null)"""

JOB_TIMES = CLIENT + TIMES


def _grid(table, key, name="grid"):
    """The grid by a real cross product of the value lists of every row."""
    return f"""
{name}_spec as (
  select {key} as s,
         [(x * 10 + {key})::varchar for x in range(1, 2 + {key} % 3)] as tasks,
         case when {key} % 2 = 0 then [' 100 '] else [' 100 ', ' 200 '] end as sorts,
         ['-Xmx' || ({key} + 200) || 'm -server', '-Xmx' || ({key} + 400) || 'm'] as opts
  from {table}),
{name}_runs as (
  select s, tasks[a] as task, sorts[b] as sort_mb, opts[c] as opt,
         row_number() over (order by s, a, b, c) - 1 as run_no
  from (select *, unnest(range(1, len(opts) + 1)) as c
        from (select *, unnest(range(1, len(sorts) + 1)) as b
              from (select *, unnest(range(1, len(tasks) + 1)) as a from {name}_spec)))),
{name} as (
  select {_run('run_no')} as expt_id, run_no, s as file_no, p.pos::bigint as pos, p.param as param,
         p.type as type, p.value as value
  from (select run_no, s, unnest([
      {{'pos': 0, 'param': 'jar_path', 'type': 'HADOOP_JAR', 'value': '/jars/job.jar'}},
      {{'pos': 1, 'param': 'jar_output_prefix', 'type': 'HADOOP_JAR', 'value': '/out/' || s}},
      {{'pos': 2, 'param': 'mapred.reduce.tasks', 'type': 'MAPREDUCE_JOBCONF', 'value': task}},
      {{'pos': 3, 'param': 'io.sort.mb', 'type': 'MAPREDUCE_JOBCONF', 'value': sort_mb}},
      {{'pos': 4, 'param': 'mapred.child.java.opts', 'type': 'MAPREDUCE_JOBCONF', 'value': opt}}
    ]) as p from {name}_runs))"""


def _moved(x):
    """Place after all half rounds of the permutation with seed 42; the row stands in the upper bits."""
    width = "((n + height - 1) // height)"
    key = "(42 * 1000003 + file_no % 2147483647 * 8191)"
    row, column = "(cell >> 31)", "(cell & 2147483647)"

    def hashed(value):
        mixed = f"(({value} + ({key} + j * 131071) % 2147483647) % 2147483647)"
        return f"(({mixed} * {mixed} % 2147483647 * 48271 + {key}) % 2147483647)"
    cell = f"""list_reduce([({x}) // {width} * 2147483648 + ({x}) % {width}, 0, 1, 2, 3, 4, 5], lambda cell, j:
        case when j % 2 = 0 then ({row} + {hashed(column)}) % height * 2147483648 + {column}
             else {row} * 2147483648 + ({column} + {hashed(row)}) % {width} end)"""
    return f"""list_transform([{cell}], lambda cell: {row} * {width} + {column})[1]"""


def _places(runs):
    """Runs with their places, moved on until they are inside their file's."""
    return f"""files as (
  select s as file_no, count(*) as n, ceil(sqrt(count(*)))::bigint as height from {runs} group by s),
places as (
  select {_run('run_no')} as expt_id, s as file_no, n, height,
         {_moved("row_number() over (partition by s order by run_no) - 1")} as place
  from {runs} join files on file_no = s),
walk as (
  select * from places
  union all
  select expt_id, file_no, n, height, {_moved("place")} from walk where place >= n)"""


CUSTOMER_GRID = _grid("customer", "c_custkey")
SUPPLIER_GRID = _grid("supplier", "s_suppkey")
NATION_GRID = _grid("nation", "n_nationkey", "other")

SIZES = "(1 + c_custkey % 3) * (1 + c_custkey % 2) * 2"

ARTIFACTS = f"""
runs as (select distinct user_id as run_order from events where event_type = 'click'),
artifacts as (
  select user_id as run_order, {_run('user_id')} as expt_id, kind,
         kind || '_' || slot as file_name, max(value) as content
  from (select *, event_id % 7 as slot,
               case when event_type in ('click', 'error') then 'userlogs'
                    when event_type = 'view' then 'history'
                    when event_type = 'purchase' then 'profiles' else 'transfers' end as kind
        from events)
  group by all),
unified as (
  select a.expt_id, a.kind, a.file_name, a.content, a.run_order
  from artifacts a join runs r using (run_order)
  where a.kind = 'userlogs')"""

JOIN = """select p_partkey, p_name, p_brand, l_orderkey, l_partkey, l_quantity
from part join lineitem on p_partkey = l_partkey"""

HOST = "'node-' || (user_id % 8)"
CPU = """value as "user", 0.1::double as nice, value / 2 as system, 1.5::double as iowait,
         0.0::double as steal, 100 - value as idle"""
SECOND = "date_trunc('second', ts)"
CPU_REPORTS = f"""select {HOST} as host, {SECOND} as ts, {CPU} from events
where event_type <> 'error'"""

UTILISATION = """round(avg(value), 7) as avg_mb_read, max(value) as max_mb_read,
        round(avg(value * 2), 7) as avg_mb_write, max(value * 2) as max_mb_write"""


def _p95(value):
    """The value whose place in the sorted list is the rounded up share of all."""
    return f"list_sort(list({value}))[ceil(0.95::double * count(*))::bigint]"


SUPPLY = """
  select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem
  union
  select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem"""

EDGES = """
edges as (
  select distinct url as src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as dst
  from pages),
lists as (
  select src as node, 0::bigint as part, array_to_string(list_sort(list(dst)), ' ') as neighbours
  from edges group by src)"""

_CLEAN = "html"
for _pattern in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', ' ', 'gis')"
_CLEAN = f"regexp_replace({_CLEAN}, '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                       ("&nbsp;", " "), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_entity}', '{_char}')"
PLAIN = f"trim(regexp_replace({_CLEAN}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"

LINE_COLUMNS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

ORACLES = {
    "attempt_times": f"""with {FACTS}
        select host, attempt_id, job_id, phase, seconds, {STATUS},
               phase = 'r' and good and cleaned as cleanup_conflict from outcome""",
    "map_attempt_times": f"""with {FACTS}
        select host, attempt_id, seconds, {STATUS} from outcome where phase = 'm'""",
    "reduce_attempt_times": f"""with {FACTS}
        select host, attempt_id, seconds, {STATUS}, good and cleaned as cleanup_conflict
        from outcome where phase = 'r'""",
    "attempt_report": f"""with {FACTS}
        select host, attempt_id || ',' || format('{{:6d}}', seconds) || ', ' ||
               case when good then 'SUCCESSFUL' else 'FAILED|KILLED' end as line
        from outcome where phase = 'm'""",
    "attempt_rejects": f"""with {LINES},
        ends as (select host, attempt_id, min(event_id) as a, max(event_id) as b
                 from lines group by all)
        select host, attempt_id, case when a % 31 = 0 then 'no time on the first line'
                                      else 'no time on the last line' end as reason
        from ends where a % 31 = 0 or b % 31 = 0""",
    "attempts_of": f"""with {LINES}
        select host, attempt_id, job_id, phase, g as task, 0 as try_no, event_id as line_no
        from lines where phase = 'm' and g % 10 = 4""",
    "spill_gaps": f"""with {LINES},
        spills as (
          select *, row_number() over (partition by g order by event_id) - 1
                    + case when event_id % 11 = 0 then 5 else 0 end as spill
          from lines where event_type = 'click'),
        seen as (
          select *, coalesce(lag(spill) over (partition by g order by event_id), -1) + 1
                    as expected
          from spills where n > 1)
        select host, attempt_id, event_id as line_no, spill, expected
        from seen where spill <> expected""",
    "job_summary": f"""with {FACTS}
        select job_id, phase, count(*) as attempts, count(*) filter (good) as successes,
               count(*) filter (not good) as failures, min(seconds) as min_seconds,
               round(avg(seconds), 7) as avg_seconds, max(seconds) as max_seconds
        from outcome group by job_id, phase""",
    "logs_for_runs": f"""with {LINES}
        select host, attempt_id, event_id as line_no from lines
        where g % 10 in (select user_id * 10 + event_id % 3 from events
                         where event_type = 'click')""",
    "shuffle_transfers": f"""with {LINES}
        select host, attempt_id, event_id as line_no from lines
        where phase = 'r' and event_type in ('view', 'error')""",
    "latest_attempts": f"""with {LINES},
        files as (select host, attempt_id, max(ts) as modified from lines group by all)
        select *, row_number() over (order by modified desc, host, attempt_id) as position
        from files""",
    "job_ids": f"with {JOB_IDS} select * from ids",
    "run_job_map": f"""with {JOB_IDS}, {RUNS}
        select {_run('run_order')} as expt_id, job_id
        from runs left join ids on ids.expt_id = {_run('run_order')}""",
    "job_run_times": f"with {JOB_TIMES} select * from job_times",
    "client_log_files": f"with {_client('user_id')}{TIMES} select * from job_times",
    "manifest_roundtrip": f"""with {JOB_IDS}, {RUNS}
        select {_run('run_order')} as expt_id, job_id
        from runs left join ids on ids.expt_id = {_run('run_order')}""",
    "experiment_stats": f"""with {SUPPLIER_GRID}, {JOB_TIMES},
        ids as (select distinct expt_id, job_id from client where event_type = 'click')
        select r.expt_id, i.job_id, t.seconds,
               task || ',' || trim(sort_mb) || ',' || split_part(opt, ' ', 1) || ',' ||
               coalesce(t.seconds::varchar, '') as row
        from (select *, {_run('run_no')} as expt_id from grid_runs) r
        join (select distinct expt_id from client) c on c.expt_id = r.expt_id
        left join ids i on i.expt_id = r.expt_id
        left join job_times t on t.expt_id = i.expt_id and t.job_id = i.job_id""",
    "sort_stats": f"""with {SUPPLIER_GRID}
        select {_run('run_no')} as expt_id, run_no, task as p0, trim(sort_mb) as p1,
               split_part(opt, ' ', 1) as p2,
               row_number() over (order by task::double, sort_mb::double, run_no) as position
        from grid_runs""",
    "design_expand": f"with {CUSTOMER_GRID} select * from grid",
    "design_ids": f"""with {CUSTOMER_GRID}
        select {_run('run_no')} as expt_id, run_no, s as file_no from grid_runs""",
    "design_size": f"""select c_custkey as file_no, {SIZES} as runs, 5::bigint as params
        from customer""",
    "design_total": f"select sum({SIZES})::bigint as runs from customer",
    "spec_values": f"""with {CUSTOMER_GRID}
        select distinct file_no, pos, param as name, type, value_no::int as value_no, value
        from (select g.*, row_number() over (partition by file_no, pos order by first) - 1
                     as value_no
              from (select file_no, pos, param, type, value, min(run_no) as first
                    from grid group by all) g)""",
    "spec_violations": """
        select c_custkey as file_no, 2::bigint as pos,
               'numvalues does not match the values' as violation
        from customer where c_custkey % 7 = 0
        union all
        select c_custkey, 3, 'numvalues must be above 0' from customer where c_custkey % 11 = 0
        union all
        select c_custkey, 4, 'unsupported type' from customer where c_custkey % 13 = 0
        union all
        select c_custkey, 0, 'unsupported program parameter' from customer
        where c_custkey % 17 = 0""",
    "run_order": f"""with {CUSTOMER_GRID}
        select {_run('run_no')} as expt_id, s as file_no,
               row_number() over (partition by s order by run_no) - 1 as place
        from grid_runs""",
    "run_order_shuffled": f"""with recursive {CUSTOMER_GRID}, {_places("grid_runs")}
        select expt_id, file_no, place from walk where place < n""",
    "run_list_file": f"""with recursive {SUPPLIER_GRID}, {_places("grid_runs")}
        select row_number() over (order by file_no, place) as position, expt_id from walk where place < n""",
    "kept_outputs": f"""with {SUPPLIER_GRID}
        select {_run('run_no')} as expt_id, '/out/' || s || '/' || {_run('run_no')} as output, 5::bigint as n
        from grid_runs where s % 3 = 0""",
    "shared_profile": f"""select {_run('o_orderkey')} as expt_id, {_job('o_custkey')} as job_id,
        '/profiles/all.xml' as profile from orders""",
    "union_designs": f"""with {SUPPLIER_GRID}, {NATION_GRID}
        select {_run('run_no')} as expt_id, 5 as n_params, task as tasks, sort_mb from grid_runs
        union all
        select {_run('run_no + 1000000000')}, 4, task, null from other_runs""",
    "design_tsv": f"""with {SUPPLIER_GRID}
        select {_run('run_no')} || chr(9) || '/jars/job.jar' || chr(9) || '/out/' || s ||
               chr(9) || task || chr(9) || sort_mb || chr(9) || opt as line
        from grid_runs
        union all
        select 'EXPT_ID' || chr(9) || 'jar_path' || chr(9) || 'jar_output_prefix' || chr(9) ||
               'mapred.reduce.tasks' || chr(9) || 'io.sort.mb' || chr(9) ||
               'mapred.child.java.opts' from grid_spec
        union all
        select '' from grid_spec""",
    "run_conf_documents": f"""with {CUSTOMER_GRID}
        select expt_id, param as name, value from grid where type = 'MAPREDUCE_JOBCONF'""",
    "run_confs_roundtrip": f"""with {SUPPLIER_GRID}
        select expt_id, param as name, value from grid where type = 'MAPREDUCE_JOBCONF'""",
    "total_sort": f"""select *, row_number() over (order by {LINE_COLUMNS}) as position
        from lineitem""",
    "word_count": r"""select word, count(*) as n
        from (select regexp_split_to_table(text, '[ \t\n\r\f]+') as word from documents)
        where word <> '' group by word""",
    "join_merge": JOIN,
    "join_broadcast": JOIN,
    "join_salted": JOIN,
    "join_partsupp": """select p_partkey, p_name, ps_partkey, ps_suppkey
        from part join (select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey
                        from lineitem) on p_partkey = ps_suppkey""",
    "merge_horizontal": """
        select a.ordinal, a.o_orderkey, a.o_orderdate, b.by_price_key, b.o_totalprice
        from (select *, row_number() over (order by o_orderkey) as ordinal from orders) a
        join (select o_orderkey as by_price_key, o_totalprice,
                     row_number() over (order by o_totalprice, o_orderkey) as ordinal
              from orders) b using (ordinal)""",
    "pair_runs": f"""
        select a.ordinal, {_run('a.k')} as expt_id, {_job('a.k')} as job_1,
               {_job('b.k + 1000000')} as job_2
        from (select o_orderkey as k, row_number() over (order by o_orderkey) as ordinal
              from orders) a
        join (select o_orderkey as k,
                     row_number() over (order by o_totalprice, o_orderkey) as ordinal
              from orders) b using (ordinal)""",
    "resolve_profiles": """
        select l_orderkey, l_linenumber, l_partkey::varchar as expt_id,
               l_partkey::varchar as job_id, coalesce(s_name, p_name) as profile
        from lineitem left join supplier on s_suppkey = l_partkey
        left join part on p_partkey * 2 = l_partkey""",
    "unify": f"with {ARTIFACTS} select * from unified",
    "unify_last_wins": f"""with {ARTIFACTS}
        select file_name, expt_id, content from unified
        qualify row_number() over (partition by file_name order by run_order desc) = 1""",
    "unify_files": f"""with {ARTIFACTS},
        files as (select run_order, expt_id, 'userlogs_' || run_order % 7 as file_name, max(content) as content
                  from unified group by all)
        select file_name, expt_id, content from files
        qualify row_number() over (partition by file_name order by run_order % 3 = 0 desc, run_order desc) = 1""",
    "jobs_with_conf": f"""
        select {_job('c_custkey')} as job_id, {_run('o_orderkey')} as expt_id,
               'localhost_1_' || {_job('c_custkey')} || '_conf.xml' as conf, c_name as owner
        from orders join customer on o_custkey = c_custkey""",
    "disk_samples": f"""select {HOST} as host, event_id * 8 + 6 as line_no, value as mb_read,
        value * 2 as mb_write from events""",
    "cpu_samples": f"""select {HOST} as host, event_id * 8 + 2 as line_no, {CPU} from events
        where event_type <> 'error'""",
    "cpu_samples_timed": f"""select {HOST} as host, event_id * 8 + 2 as line_no, {SECOND} as ts,
        {CPU} from events where event_type <> 'error'""",
    "memory_samples": f"""select {HOST} as host, event_id * 8 + 3 as line_no, event_id as swpd,
        user_id + 1000 as free, floor(value * 4)::bigint as buff, length(props) as cache
        from events""",
    "monitor_summary": f"""select {HOST} as host, count(*) as samples,
        round(avg(value), 7) as avg_mb_read, max(value) as max_mb_read,
        round(avg(value * 2), 7) as avg_mb_write,
        max(value * 2) as max_mb_write,
        {_p95('value')} as p95_mb_read, {_p95('value * 2')} as p95_mb_write
        from events group by 1""",
    "cpu_summary": f"""select {HOST} as host, count(*) as samples,
        round(avg(value), 7) as avg_user, max(value) as max_user,
        round(avg(100 - value), 7) as avg_idle,
        max(100 - value) as max_idle,
        {_p95('value')} as p95_user, {_p95('100 - value')} as p95_idle
        from events where event_type <> 'error' group by 1""",
    "stream_samples": f"""select {HOST} as host, {SECOND} as ts, value as mb_read,
        value * 2 as mb_write from events""",
    "stream_cpu_samples": CPU_REPORTS,
    "cpu_report_files": CPU_REPORTS,
    "stream_utilisation": f"""select date_trunc('hour', ts) as window_start, {HOST} as host,
        count(*) as samples, round(avg(value), 7) as avg_mb_read, max(value) as max_mb_read,
        round(avg(value * 2), 7) as avg_mb_write, max(value * 2) as max_mb_write
        from events group by 1, 2""",
    "gen_tpch": """
        with scale as (select count(*) / 6000000 as f from lineitem),
        o as (select greatest(1, round(1500000 * f))::bigint as n from scale),
        p as (select greatest(1, round(200000 * f))::bigint as n from scale)
        select 'region' as tbl, 5::bigint as n, 0::bigint as first_key, 4::bigint as last_key
        union all select 'nation', 25, 0, 24
        union all select 'supplier', greatest(1, round(10000 * f))::bigint, 1,
                         greatest(1, round(10000 * f))::bigint from scale
        union all select 'customer', greatest(1, round(150000 * f))::bigint, 1,
                         greatest(1, round(150000 * f))::bigint from scale
        union all select 'part', n, 1, n from p
        union all select 'partsupp', 4 * n, 1, n from p
        union all select 'orders', n, 1, n from o
        union all select 'lineitem',
            (select sum(1 + k % 7)::bigint from range(1, n + 1) r(k)), 1, n from o""",
    "gen_tpch_values": """
        with scale as (select count(*) / 6000000 as f from lineitem),
        o as (select greatest(1, round(1500000 * f))::bigint as n from scale),
        p as (select greatest(1, round(200000 * f))::bigint as n from scale),
        sizes as (
            select 'region' as tbl, 5::bigint as n union all select 'nation', 25
            union all select 'supplier', greatest(1, round(10000 * f))::bigint from scale
            union all select 'customer', greatest(1, round(150000 * f))::bigint from scale
            union all select 'part', n from p union all select 'partsupp', 4 * n from p
            union all select 'orders', n from o
            union all select 'lineitem', (select sum(1 + k % 7)::bigint from range(1, n + 1) r(k)) from o),
        -- columns by table, with the length of the list where a column is one
        cols(tbl, names) as (values
            ('region', 'r_regionkey r_name:5 r_comment'),
            ('nation', 'n_nationkey n_name:25 n_regionkey n_comment'),
            ('supplier', 's_suppkey s_name s_address s_nationkey s_phone s_acctbal s_comment'),
            ('customer', 'c_custkey c_name c_address c_nationkey c_phone c_acctbal c_mktsegment:5 c_comment'),
            ('part', 'p_partkey p_name p_mfgr:5 p_brand p_type:6 p_size p_container:6 p_retailprice p_comment'),
            ('partsupp', 'ps_partkey ps_suppkey ps_availqty ps_supplycost ps_comment'),
            ('orders', 'o_orderkey o_custkey o_orderstatus:3 o_totalprice o_orderdate o_orderpriority:5 o_clerk o_shippriority:1 o_comment'),
            ('lineitem', 'l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag:3 l_linestatus:2 l_shipdate l_commitdate l_receiptdate l_shipinstruct:4 l_shipmode:6 l_comment')),
        each as (select tbl, unnest(string_split(names, ' ')) as entry from cols)
        select tbl, split_part(entry, ':', 1) as col, n, 0::bigint as odd,
               nullif(split_part(entry, ':', 2), '')::bigint as listed
        from each join sizes using (tbl)""",
    "gen_sort_records": """select count(*) as records, 100 * count(*) as bytes, 100 as smallest,
        100 as largest, count(*) as keys from orders""",
    "gen_random_text": """select 5 as min_key, 10 as max_key, 5 as min_value, 10 as max_value
        from (select count(*) from documents)""",
    "zipf_key": """
        with total as (select count(*)::double as n from orders),
        weights as (select k, 1.0::double / k as w from range(1, 2001) r(k)),
        bounds as (select k, sum(w) over (order by k) / (select sum(w) from weights) as hi,
                          (sum(w) over (order by k) - w) / (select sum(w) from weights) as lo
                   from weights)
        select k as rank, count(*) as n
        from (select (o_orderkey + 0.5) / n as u from orders, total)
        join bounds on u >= lo and u < hi group by k""",
    "write_roundtrip": "select * from lineitem",
    "run_output_roundtrip": "select * from orders",
    "tsv_roundtrip": "select * from customer",
    "sequence_roundtrip": "select row_number() over (order by page_id) as docno, html from pages",
    "text_roundtrip": "select * from documents",
    "tpch_scan": """
        select c_custkey::int as c_custkey, c_name, null::varchar as c_address, c_nationkey, '' as c_phone,
               c_acctbal::decimal(15,2)::double as c_acctbal, c_mktsegment,
               ' padded | ' || c_name || chr(10) as c_comment
        from customer""",
    "wiki_dump": "select page_id, url as title, html as text from pages",
    "plain_text": f"select page_id, {PLAIN} as plain from pages",
    "doc_numbers": "select page_id, row_number() over (order by page_id) as docno from pages",
    "repack": "select row_number() over (order by page_id) as docno, url, html from pages",
    "link_edges": f"with {EDGES} select * from edges",
    "adjacency": f"with {EDGES} select * from lists",
    "bfs_encode": f"""with {EDGES}
        select *, case when node = (select min(url) from pages) then 0 end as dist from lists""",
    "bfs": """
        with recursive links as (
          select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem
          union
          select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem),
        walk(node, dist) using key (node) as (
          select 'p0', 0
          union
          select links.dst, min(walk.dist + 1)
          from walk join links on links.src = walk.node left join recurring.walk known on known.node = links.dst
          where known.node is null group by links.dst)
        select node, dist::int as dist from walk""",
    "adjacency_parts": SUPPLY,
    "text_corpus": r"""select word, count(*) as n
        from (select regexp_split_to_table(text, '[ \t\n\r\f]+') as word from documents)
        where word <> '' group by word""",
    "join_reducers": JOIN,
    "disk_sample_files": f"""select {HOST} as host, {SECOND} as ts, value as mb_read,
        value * 2 as mb_write from events""",
    "memory_sample_files": f"""select {HOST} as host, {SECOND} as ts, event_id as swpd,
        user_id + 1000 as free, floor(value * 4)::bigint as buff, length(props) as cache
        from events""",
    "attempt_log_files": f"""with {FACTS}
        select host, attempt_id, job_id, phase, seconds, {STATUS},
               phase = 'r' and good and cleaned as cleanup_conflict from outcome""",
    "job_conf_files": f"""
        select {_job('c_custkey')} as job_id, {_run('o_orderkey')} as expt_id,
               'localhost_1_' || {_job('c_custkey')} || '_conf.xml' as conf, c_name as owner
        from orders join customer on o_custkey = c_custkey""",
    "spec_files": f"""with {SUPPLIER_GRID}
        select distinct dense_rank() over (order by file_no) - 1 as file_no, file_no as source, pos, param as name,
               type, value_no::int as value_no, value
        from (select g.*, row_number() over (partition by file_no, pos order by first) - 1 as value_no
              from (select file_no, pos, param, type, value, min(run_no) as first
                    from grid group by all) g)""",
    "stream_late_rows": f"""
        select date_trunc('hour', ts) as window_start, {HOST} as host,
               count(*) * case when date_trunc('hour', ts) + interval 1 hour >
                   (select max({SECOND}) - interval 2 minutes from events) then 2 else 1 end as samples,
        {UTILISATION}
        from events group by 1, 2""",
    "stream_redelivered": f"""
        select date_trunc('hour', ts) as window_start, {HOST} as host, count(*) as samples, {UTILISATION}
        from (select distinct user_id % 8 as user_id, {SECOND} as ts, value from events) group by 1, 2""",
    "stream_percentiles": f"""
        select level, date_trunc(level, ts) as window_start, {HOST} as host, count(*) as samples,
               {_p95('value')} as p95_mb_read, {_p95('value * 2')} as p95_mb_write
        from events, (select unnest(['hour', 'day']) as level) group by 1, 2, 3""",
    "unify_packed": f"""with {ARTIFACTS},
        latest as (select file_name, expt_id, content from unified
                   qualify row_number() over (partition by file_name order by run_order desc) = 1)
        select file_name, expt_id, 0::bigint as line_no, content, null::varchar as origin from latest
        union all select file_name, expt_id, 1, null, expt_id || '/' || file_name from latest""",
    "random_text_like": """
        select concat_ws('/', source, lang) as name, sum(n_chars)::bigint as bytes, 0::bigint as odd_rows
        from documents group by 1""",
    "plain_text_wiki": """
        select page_id, 'Page ' || page_id || ' see the next and Page ' || (page_id % 10)
                        || '. Source ' || url || ' }} {{ end' as plain
        from pages""",
    "link_edges_wiki": """
        select url as src, 'Page ' || (page_id + 1) as dst from pages
        union select url, 'Page ' || (page_id % 10) from pages
        union select url, unnest(['File:a.jpg', 'y']) from pages""",
}
