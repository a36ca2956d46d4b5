"""Data generators. Every value is a hash of the seed and the row number, so a
lost task writes the same rows again. The value rules are our own."""

from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.sampling import pick, uniform, zipf_rank
from runledger.session import shuffle_partitions

# The regions and nations, and rows per table at scale factor 1.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4),
    ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2),
    ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0),
    ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4),
    ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1)]
ROWS = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000}
SUPPLIERS_PER_PART = 4
MAX_LINES = 7

SYLLABLES = ["ba", "co", "di", "fe", "go", "hu", "ji", "ka", "lo", "mu",
             "ne", "pi", "qua", "ro", "su", "ti", "ve", "wo", "xa", "zy"]
COLOURS = ["amber", "black", "blue", "coral", "green", "grey", "ivory", "red", "violet", "white"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CONTAINERS = ["BAG", "BOX", "CAN", "CASE", "DRUM", "JAR"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
INSTRUCTIONS = ["COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN"]
MODES = ["AIR", "FOB", "MAIL", "RAIL", "SHIP", "TRUCK"]
FIRST_DAY = "1992-01-01"
DAYS = 2405

RECORD_BYTES = 100
KEY_BYTES = 10
ROWID_BYTES = 20
TEXT_CHUNK = 1 << 16
LEAST_CHUNK = 1 << 12


def _list(words):
    return F.split(F.lit(",".join(words)), ",")


def _one_of(words, seed, *columns):
    return F.get(_list(words), pick(seed, 0, len(words) - 1, *columns).cast("int"))


def _words(seed, low, high, *columns):
    """A sentence of low to high words, each made of two or three syllables."""
    syllables = _list(SYLLABLES)

    def word(i):
        part = [F.get(syllables, pick(seed + j, 0, len(SYLLABLES) - 1, *columns, i).cast("int"))
                for j in range(1, 4)]
        third = F.when(uniform(seed + 4, *columns, i) < 0.5, part[2]).otherwise("")
        return F.concat(part[0], part[1], third)

    count = pick(seed, low, high, *columns)
    return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), count), word), " ")


def table_rows(sf):
    """Rows per table; line items follow from the orders, 1 to 7 each."""
    rows = {name: max(1, round(n * sf)) for name, n in ROWS.items()}
    rows["region"], rows["nation"] = len(REGIONS), len(NATIONS)
    rows["partsupp"] = rows["part"] * SUPPLIERS_PER_PART
    full, rest = divmod(rows["orders"], MAX_LINES)
    # Order k has 1 + k mod 7 lines.
    rows["lineitem"] = full * sum(range(1, MAX_LINES + 1)) + sum(
        1 + k % MAX_LINES for k in range(1, rest + 1))
    return rows


def check_scale(sf, num_files, zipf):
    if sf <= 0:
        raise ValueError("the scale factor must be greater than 0")
    if num_files < sf / 2:
        raise ValueError("the number of files must be at least half the scale factor")
    if not 0 <= zipf <= 4:
        raise ValueError("the zipf factor must be between 0 and 4")


def gen_tpch(spark, sf, num_files=1, zipf=0.0, seed=42):
    """The eight benchmark tables, each of the big ones in `num_files` partitions.

    Foreign keys follow the zipf factor, 0 is uniform. Keys become long when
    the largest of them no longer fits 32 bits.
    """
    check_scale(sf, num_files, zipf)
    rows = table_rows(sf)
    wide = rows["orders"] > 2**31 - 1
    ids = {name: spark.range(1, rows[name] + 1, numPartitions=num_files)
           for name in ("supplier", "customer", "part", "orders")}
    k = F.col("id")

    def key(table, salt, *columns):
        return zipf_rank(uniform(seed + salt, *columns), rows[table], zipf)

    def money(salt, low, high, *columns):
        return pick(seed + salt, low * 100, high * 100, *columns) / 100

    def day(salt, *columns):
        return F.date_add(F.lit(FIRST_DAY).cast("date"),
                          pick(seed + salt, 0, DAYS, *columns).cast("int"))

    def phone(salt):
        return F.format_string("%02d-%03d-%03d-%04d", pick(seed + salt, 10, 34, k),
                               pick(seed + salt + 1, 100, 999, k),
                               pick(seed + salt + 2, 100, 999, k),
                               pick(seed + salt + 3, 1000, 9999, k))

    def named(label):
        return F.format_string(f"{label}#%09d", k)

    n = F.col("line").cast("long")
    shipped = F.date_add(F.col("day"), pick(seed + 50, 1, 121, k, n).cast("int"))
    region = F.get(_list(REGIONS), k.cast("int"))
    frame = {
        "region": spark.range(0, len(REGIONS), numPartitions=1).select(
            k, region, _words(seed + 60, 4, 9, k)),
        "nation": spark.range(0, len(NATIONS), numPartitions=1).select(
            k, F.get(_list([name for name, _ in NATIONS]), k.cast("int")),
            F.get(_list([str(r) for _, r in NATIONS]), k.cast("int")),
            _words(seed + 65, 4, 9, k)),
        "supplier": ids["supplier"].select(
            k, named("Supplier"), _words(seed + 70, 2, 4, k), pick(seed + 75, 0, 24, k),
            phone(76), money(80, -999, 9999, k), _words(seed + 81, 4, 9, k)),
        "customer": ids["customer"].select(
            k, named("Customer"), _words(seed + 90, 2, 4, k), pick(seed + 95, 0, 24, k),
            phone(96), money(100, -999, 9999, k), _one_of(SEGMENTS, seed + 101, k),
            _words(seed + 102, 4, 9, k)),
        "part": ids["part"].select(
            k, F.concat_ws(" ", _one_of(COLOURS, seed + 110, k), _one_of(COLOURS, seed + 111, k)),
            F.format_string("Manufacturer#%d", pick(seed + 112, 1, 5, k)),
            F.format_string("Brand#%d", pick(seed + 113, 11, 55, k)),
            _one_of(TYPES, seed + 114, k), pick(seed + 115, 1, 50, k),
            _one_of(CONTAINERS, seed + 116, k), money(117, 900, 2000, k),
            _words(seed + 118, 1, 3, k)),
        "partsupp": ids["part"].withColumn(
            "line", F.explode(F.sequence(F.lit(0), F.lit(SUPPLIERS_PER_PART - 1)))).select(
            k, F.pmod(k + n * F.lit(max(1, rows["supplier"] // SUPPLIERS_PER_PART)),
                      F.lit(rows["supplier"])) + 1,
            pick(seed + 120, 1, 9999, k, n), money(121, 1, 1000, k, n),
            _words(seed + 122, 6, 15, k, n)),
        "orders": ids["orders"].select(
            k, key("customer", 130, k), _one_of(["F", "O", "P"], seed + 131, k),
            money(132, 900, 500000, k), day(133, k), _one_of(PRIORITIES, seed + 134, k),
            F.format_string("Clerk#%09d", pick(seed + 135, 1, 1000, k)), F.lit(0),
            _words(seed + 136, 3, 8, k)),
        "lineitem": ids["orders"].select(k, day(133, k).alias("day"), F.explode(F.sequence(
            F.lit(1).cast("long"), 1 + k % MAX_LINES)).alias("line")).select(
            k, key("part", 140, k, n), key("supplier", 141, k, n), n,
            pick(seed + 142, 1, 50, k, n), money(143, 900, 95000, k, n),
            pick(seed + 144, 0, 10, k, n) / 100, pick(seed + 145, 0, 8, k, n) / 100,
            _one_of(["A", "N", "R"], seed + 146, k, n), _one_of(["F", "O"], seed + 147, k, n),
            shipped, F.date_add(F.col("day"), pick(seed + 148, 30, 90, k, n).cast("int")),
            F.date_add(shipped, pick(seed + 149, 1, 30, k, n).cast("int")),
            _one_of(INSTRUCTIONS, seed + 150, k, n), _one_of(MODES, seed + 151, k, n),
            _words(seed + 152, 2, 6, k, n)),
    }
    tables = {}
    for name, df in frame.items():
        fields = schemas.tpch(name, wide).fields
        df = df.toDF(*[f.name for f in fields])
        tables[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    return tables


def gen_sort_records(spark, n, tasks, seed=42):
    """n records of 100 bytes: 10 bytes of random key, 20 digits of row id, filler."""
    k = F.col("id")
    digits = F.concat(F.hex(F.xxhash64(F.lit(seed), k)), F.hex(F.xxhash64(F.lit(seed + 1), k)))
    key = F.unhex(F.substring(F.lpad(digits, 32, "0"), 7, 2 * KEY_BYTES))
    filler = F.rpad(_words(seed + 2, 8, 12, k), RECORD_BYTES - KEY_BYTES - ROWID_BYTES, ".")
    return spark.range(n, numPartitions=tasks).select(
        key.alias("key"), F.lpad(k.cast("string"), ROWID_BYTES, "0").alias("rowid"),
        filler.alias("filler"))


def gen_random_text(spark, bytes_per_task, tasks, key_words=(5, 10), value_words=(5, 10), seed=42):
    """Random sentences as key and value, exactly `bytes_per_task` in every task.

    A row takes its key, its value, a tab and a line end.
    """
    sizes = spark.range(tasks, numPartitions=tasks).select("id", F.lit(bytes_per_task).cast("long").alias("bytes"))
    return random_text_like(sizes, "id", "bytes", key_words, value_words, seed, placed=True).select("key", "value")


def _bound(value, body):
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunk_text(size, key_words, value_words, seed, *columns):
    """Lines of `key<tab>value` of exactly `size` bytes with their line ends, of which the final one is left out; the last
    line is stretched to the end.

    The number of lines follows from the mean length: words have two or three
    syllables of 2.05 letters on average and a blank behind. If they still fall
    short they are repeated. What is left behind the last whole line goes to its last word as letters, so
    all lines have as many words as asked for; only a size below one line cuts it.
    """
    letters = sum(map(len, SYLLABLES)) / len(SYLLABLES) * 2.5 + 1
    mean = letters * (sum(key_words) + sum(value_words)) / 2
    lines = F.sequence(F.lit(1).cast("long"), F.ceil(size / F.lit(mean) * 1.1).cast("long") + 3)
    text = F.concat(F.array_join(F.transform(lines, lambda i: F.concat(
        _words(seed, *key_words, *columns, i), F.lit("\t"), _words(seed + 10, *value_words, *columns, i))), "\n"), F.lit("\n"))
    n = size.cast("int")

    def ended(cut):
        return _bound(n - F.instr(F.reverse(cut), "\n"), lambda whole: F.when(
            whole < n, F.rpad(F.left(cut, whole), n - 1, "ba")).otherwise(
            F.concat(F.translate(F.left(cut, n - 2), "\t", " "), F.lit("\t"))))
    return _bound(_bound(text, lambda all_lines: F.rpad(all_lines, n, all_lines)), ended)


def random_text_like(sizes, name, size, key_words=(5, 10), value_words=(5, 10), seed=42, placed=False):
    """Random sentences of exactly as many bytes as `sizes` asks for: (name, key, value).

    `sizes` has one row per name and its bytes, 2 or more; none or fewer give no row.
    A name is cut in chunks of TEXT_CHUNK bytes and each is made on its own, so a
    name with most of the bytes is shared by tasks. A rest below LEAST_CHUNK goes to the chunk before it.
    `placed` says that the rows of `sizes` are spread evenly already; then nothing is shuffled.
    """
    n = F.col(size).cast("long")
    count = F.greatest(F.call_function("div", n + (TEXT_CHUNK - LEAST_CHUNK), F.lit(TEXT_CHUNK)), F.lit(1))
    asked = sizes.filter(n >= 2).select(F.col(name), n.alias("_n"), count.cast("long").alias("_count"))
    chunks = asked.select(name, "_n", "_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)).alias("_chunk"))
    if not placed:
        # An explicit number: these rows are tiny and would be coalesced to one task.
        chunks = chunks.repartition(shuffle_partitions(sizes.sparkSession), name, "_chunk")
    own = F.when(F.col("_chunk") == F.col("_count") - 1, F.col("_n") - F.col("_chunk") * TEXT_CHUNK).otherwise(F.lit(TEXT_CHUNK))
    text = chunks.select(name, _chunk_text(own, key_words, value_words, seed, F.col(name), F.col("_chunk")).alias("_text"))
    lines = text.select(name, F.explode(F.split("_text", "\n")).alias("_line"))
    return lines.select(name, F.substring_index("_line", "\t", 1).alias("key"), F.substring_index("_line", "\t", -1).alias("value"))
