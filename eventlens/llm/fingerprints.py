"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph is hashed to a wide vector of plus and minus ones, and a text's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two.  So the order of paragraphs
doesn't matter, fingerprints of parts add up, and paragraphs are inserted or deleted by adding or
subtracting theirs.  Lanes are random signs, so products of two fingerprints estimate the
paragraphs that the texts share: their cosine is the likeness.  Everything is DataFrame expressions.

Paragraphs end after a newline, or after a full stop, question or exclamation mark and a blank; each
keeps its end, so a text's paragraphs are all of its characters.  A null text is an empty one, which
has one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from eventlens.llm.common import table

#: A paragraph's sha256 gives three words of 60 bits, a bit a lane.
WORDS, BITS = 3, 60
LANES = WORDS * BITS

#: Lanes are kept modulo 2**24, six hex digits each.
MODULUS, DIGITS = 1 << 24, 6

#: Three bits of a word are counted in one sum, bits i, i + 20 and i + 40, each in a field of 20 bits: enough
#: for the paragraphs of a CHUNK.
FIELD = 20
_PICK = 1 | 1 << FIELD | 1 << 2 * FIELD
CHUNK = 1 << FIELD - 1

#: Ranges that documents are dealt by, for each shuffle partition, and most of all.
RANGES, MOST_RANGES = 8, 65_536


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=\n)|(?<=[.!?] )")


def hashed(paragraph: Column) -> list[Column]:
    """The words of BITS bits of a paragraph's sha256."""
    return [F.conv(F.substring(F.sha2(paragraph, 256), k * BITS // 4 + 1, BITS // 4), 16, 10).cast("long") for k in range(WORDS)]


def lane_sums(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., lanes): the fingerprint of each text, as an array of LANES numbers.

    ``keys`` tell texts apart; a text of more than CHUNK paragraphs has a row for each chunk, to be added up.
    This is one aggregation over paragraphs, which needs no shuffle where the frame is dealt by some of the keys.
    """
    parts = texts.select(*keys, F.posexplode(paragraphs(F.col(text))).alias("_i", "_p"))
    parts = parts.select(*keys, F.floor(F.col("_i") / CHUNK).alias("_chunk"), *[h.alias(f"_h{k}") for k, h in enumerate(hashed(F.col("_p")))])
    each = [(k, i) for k in range(WORDS) for i in range(FIELD)]
    bits = [F.sum(F.shiftright(f"_h{k}", i).bitwiseAND(F.lit(_PICK))).alias(f"_s{k}_{i}") for k, i in each]
    summed = parts.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), *bits)
    packed = F.array(*[F.col(f"_s{k}_{i}") for k, i in each])
    field = lambda at: F.transform(packed, lambda c: F.shiftright(c, at * FIELD).bitwiseAND(F.lit((1 << FIELD) - 1)))
    ones = F.concat(*[field(at) for at in range(BITS // FIELD)])
    return summed.select(*keys, F.transform(ones, lambda c: F.pmod(2 * c - F.col("_n"), F.lit(MODULUS))).alias("lanes"))


def lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., lanes) of each text, chunks added up."""
    return lane_sums(texts, keys, text).groupBy(*keys).agg(in_one(F.collect_list("lanes")).alias("lanes"))


def in_one(chunks: Column) -> Column:
    """The sum of an array of lanes; null of none."""
    rest = F.slice(chunks, 2, F.greatest(F.size(chunks), F.lit(1)))
    return F.aggregate(rest, F.get(chunks, F.lit(0)), added)


def written(vector: Column) -> Column:
    """An array of lanes as a string of hex digits; two lanes are written at a time, after a leading 1."""
    pair = lambda j: F.get(vector, 2 * j) * MODULUS + F.get(vector, 2 * j + 1) + MODULUS * MODULUS
    digits = F.transform(F.sequence(F.lit(0), F.lit(LANES // 2 - 1)), lambda j: F.substring(F.hex(pair(j)), 2, 2 * DIGITS))
    return F.lower(F.array_join(digits, ""))


def read_lanes(fingerprint: Column) -> Column:
    """The array of lanes that ``written`` wrote."""
    at = F.sequence(F.lit(1), F.lit(1 + DIGITS * (LANES - 1)), F.lit(DIGITS))
    return F.transform(at, lambda i: F.conv(F.substr(fingerprint, i, F.lit(DIGITS)), 16, 10).cast("long"))


def added(a: Column, b: Column) -> Column:
    """Lanes of both multisets together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def removed(a: Column, b: Column) -> Column:
    """Lanes of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of lanes, 0 to 1, of six decimals; equal ones have 1, less than 0 counts as 0.

    For texts whose paragraphs are distinct it estimates the share of common paragraphs, about
    1 / sqrt(LANES) = 0.075 off.  A paragraph that occurs more than 8 million times wraps its lanes.
    """
    signed = lambda x: x - F.shiftleft(F.shiftright(x, 23), 24)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: signed(p) * signed(q)), F.lit(0).cast("long"), lambda s, p: s + p).cast("double")
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    near = F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(dot(a, b) / scale, 6)))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with the text of the next one in descending order of an integer key, dealt by ``range``.

    Columns: range, at (place in the order), guest, copies, id, text, next_text.  Documents are dealt to
    ranges of keys and each range's first row also, as a guest (1), to the range before, after the last
    range comes the first: so a text is shuffled once.  A guest stands last in its range and has no next
    text of its own.  The driver holds one key for each range.  Equal rows are one row with its copies.
    """
    spark = docs.sparkSession
    clean = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the key and 32 bits of the text's hash as one number; a null key is less than any
    tie = F.pmod(F.xxhash64("text"), F.lit(1 << 32)).cast("decimal(10,0)")
    number = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    placed = (number * F.lit(1 << 32).cast("decimal(10,0)") + tie).cast("decimal(38,0)")
    keys = clean.select(placed.alias("at"))
    parts = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = keys.repartitionByRange(parts, F.desc("at")).groupBy(F.spark_partition_id()).agg(F.max("at").alias("top")).collect()
    tops = sorted({r["top"] for r in tops}, reverse=True) or [0]
    many = keys.groupBy("at").count().where("count > 1").limit(1).count() > 0
    rows = clean.groupBy("id", "text").agg(F.count("*").alias("copies")) if many else clean.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumn("at", placed)

    # how many tops aren't below the key: first groups of tops, then inside one
    wide = max(1, int(len(tops) ** 0.5))
    groups = [tops[i : i + wide] for i in range(0, len(tops), wide)]
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<decimal(38,0)>")  # noqa: E731  folded to a literal
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), lambda g: F.split(g, ",").cast("array<decimal(38,0)>"))
    passed = lambda xs: F.size(F.filter(xs, lambda t: t >= F.col("at")))
    rows = rows.withColumn("_group", passed(numbers([g[0] for g in groups])) - 1)
    inside = F.get(nested, F.col("_group"))
    rows = rows.withColumn("range", F.col("_group") * wide + passed(inside) - 1)
    is_top = F.get(inside, F.col("range") - F.col("_group") * wide) == F.col("at")
    other = F.when(is_top, F.pmod(F.col("range") - 1, F.lit(len(tops))))
    homes = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(other.alias("range"), F.lit(1).alias("guest")))
    dealt = rows.select("at", "copies", "id", "text", F.explode(F.filter(homes, lambda h: h["range"].isNotNull())).alias("_home"))
    dealt = dealt.select("_home.range", "at", "_home.guest", "copies", "id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(in_range()))


def in_range() -> WindowSpec:
    return Window.partitionBy("range").orderBy("guest", F.desc("at"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): each row with the text of the next one in descending order of an integer key.

    After the last comes the first; a single row is its own next.  Null keys come last, rows that
    share a key in the order of a hash of their text, and of equal rows each is followed by its like.
    Null texts are empty.
    """
    own = followed(docs, key, text).where("guest = 0")
    each = own.select("id", "text", "next_text", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_i"))
    return each.select(F.col("id").alias(key), F.col("text").alias(text), F.when(F.col("_i") < F.col("copies"), F.col("text")).otherwise(F.col("next_text")).alias("next_text"))


def edited_texts(text: str, other: str) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(F.col(text), F.lit(1), n - half), F.substr(F.col(other), F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Edited texts and next ones as in ``edited_texts`` and ``with_next``.  Texts are shuffled once, by
    ranges of the order; all sums and both looks at the next row keep to that partitioning.
    """
    rows = followed(docs, key, text)
    likes = F.when((F.col("guest") == 0) & (F.col("copies") > 1), F.struct(F.lit(2).alias("kind"), edited_texts("text", "text").alias("t")))
    after = F.when(F.col("guest") == 0, F.struct(F.lit(1).alias("kind"), edited_texts("text", "next_text").alias("t")))
    kinds = F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), after, likes))
    place = ["range", "at", "guest", "copies", "id"]
    texts = rows.select(*place, F.explode(kinds).alias("x")).select(*place, "x.kind", "x.t")
    keys = [*place, "kind", "n_chars", "sha256"]
    sums = lane_sums(texts.withColumns({"n_chars": F.length("t").cast("long"), "sha256": F.when(F.col("kind") > 0, F.sha2("t", 256))}), keys, "t")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    all_of = lambda kind: in_one(F.collect_list(F.when(F.col("kind") == kind, F.col("lanes"))))
    each = sums.groupBy(*place).agg(
        of(0, "n_chars").alias("n_chars"), all_of(0).alias("own"), all_of(1).alias("changed"), of(1, "sha256").alias("sha256"), all_of(2).alias("alike"), of(2, "sha256").alias("alike_sha256")
    )
    each = each.withColumn("next", F.lead("own").over(in_range())).where("guest = 0")
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    like = F.col("_i") < F.col("copies")  # this copy is followed by another
    pick = lambda a, b: F.when(like, F.col(a)).otherwise(F.col(b))
    each = each.select("id", "n_chars", "own", pick("alike", "changed").alias("changed"), pick("alike_sha256", "sha256").alias("sha256"), pick("own", "next").alias("next"))
    return each.select(
        F.col("id").alias(key), "n_chars", F.col("sha256").alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fingerprints": op13_fingerprints}


def _lanes_sql(text: str) -> tuple[str, str]:
    """Paragraphs, cut at a mark put after each end, and their hashes, a list for each word."""
    hashes = "[" + ", ".join(f"list_transform(ps, lambda p: CAST('0x' || substr(sha256(p), {k * 15 + 1}, 15) AS BIGINT))" for k in range(WORDS)) + "]"
    cut = rf"string_split(regexp_replace(coalesce({text}, ''), '(\n|[.!?] )', '\1' || chr(57344), 'g'), chr(57344))"
    return cut, hashes


def _sql() -> str:
    cut, hashes = _lanes_sql("text")
    signed = lambda x: f"CASE WHEN {x} >= {MODULUS // 2} THEN {x} - {MODULUS} ELSE {x} END"
    dot = lambda a, b: f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: ({signed('z[1]')}) * ({signed('z[2]')}))) AS DOUBLE)"
    near = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 6))) END"
    hexed = lambda a: f"array_to_string(list_transform({a}, lambda c: lower(lpad(hex(c), {DIGITS}, '0'))), '')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next
  FROM documents),
e AS MATERIALIZED (
  SELECT doc_id, length(text) AS n, text, next, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM d),
ps AS (
  SELECT text, {cut} AS ps FROM (SELECT text FROM e UNION SELECT edited FROM e)),
hs AS (SELECT text, len(ps) AS n, {hashes} AS hs FROM ps),
fp AS MATERIALIZED (
  SELECT text, list_transform(range({LANES}), lambda j:
    ((2 * list_sum(list_transform(hs[(j % {WORDS * FIELD}) // {FIELD} + 1], lambda h: (h >> (j % {FIELD} + {FIELD} * (j // {WORDS * FIELD}))) & 1)) - n)
     % {MODULUS} + {MODULUS}) % {MODULUS}) AS v
  FROM hs)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       {hexed('a.v')} AS fingerprint, {hexed('b.v')} AS edited_fingerprint,
       {near('a.v', 'b.v')} AS near_edited, {near('a.v', 'c.v')} AS near_next
FROM e JOIN fp a ON a.text = e.text JOIN fp b ON b.text = e.edited JOIN fp c ON c.text = e.next
"""


ORACLES = {"op13_fingerprints": _sql()}
