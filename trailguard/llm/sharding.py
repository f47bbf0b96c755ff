"""Sharding: documents in the order of a Hilbert curve over their metadata, cut into shards. DataFrame functions only.

Each dimension is quantised to 32 levels by exact ranks: a value's level is the share of rows with smaller values, so
levels keep the values' order and hot values don't crowd the others. The levels of all dimensions are one point, its index
on the Hilbert curve orders the rows, and shards are runs of that order: rows near each other in all dimensions share
shards, so the minima and maxima of a shard's files rule it out for most filters on any of the dimensions.

Ranks are prefix sums: rows are range-partitioned and sorted, every row knows its place in its partition, and only the
partitions' totals are added up in one task. Rows that tie in everything are still told apart by their place in the input,
so no value, however hot, holds a partition together.

Null is a value of its own, before all others; a null text has size 1 and the CRC-32 of no bytes; rows that tie are in an
arbitrary order, which no returned column but their slots shows; a table of n rows fills the first n of too many shards by
the law `rows`, one row each, evenly spread; an empty table gives no rows. Columns of the documents travel in the struct
`row`, so their names and types are free.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_row, save, settled, shuffle_partitions, table

#: Bits, that is levels as a power of two, of each dimension.
BITS = 5
SHARDS = 8
#: monotonically_increasing_id() has the partition above this bit and the place in the partition below.
_PLACE = 33


def ranked(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """rows in the order of keys, saved, with `before` (rows, or the sum of weight, that stand before) and `of` (all)."""
    spark = rows.sparkSession
    tied = rows.withColumn("input", F.monotonically_increasing_id())
    order = [*keys, "input"]
    placed = save(tied.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("input").withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("at", _PLACE))
    one = F.lit(1) if weight is None else F.col(weight)
    up = Window.orderBy("part")  # one row a partition
    totals = placed.groupBy("part").agg(F.sum(one).cast("long").alias("n"))
    totals = totals.select("part", (F.sum("n").over(up) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("of"))
    if weight is None:
        within = F.col("at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    else:
        within = F.sum(weight).over(Window.partitionBy("part").orderBy("at")) - F.col(weight)
    placed = placed.withColumn("within", within.cast("long"))
    return placed.join(F.broadcast(totals), "part").withColumn("before", F.col("base") + F.col("within")).drop("part", "at", "base", "within")


def cuts(rows: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list[tuple[object, int]]]:
    """For each dimension the values at which a new level begins, ascending, with the level: at most 2^bits of them."""
    kinds = dict(rows.select(*dims).dtypes)
    each = [F.struct(F.lit(i).alias("dim"), *[(F.col(d) if d == e else F.lit(None).cast(kinds[e])).alias(f"v_{e}") for e in dims]) for i, d in enumerate(dims)]
    values = [f"v_{d}" for d in dims]
    counts = rows.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("dim", *values).count()
    found = ranked(counts, ["dim", *values], "count")
    # each row stands once in every dimension
    share = (F.col("before") - F.col("dim") * (F.col("of") / F.lit(len(dims))).cast("long")) * F.lit(len(dims)) * F.lit(1 << bits)
    levels = found.withColumn("level", F.floor(share / F.col("of")).cast("int"))
    first = levels.groupBy("dim", "level").agg(*[F.min(v).alias(v) for v in values])
    out: dict[str, list[tuple[object, int]]] = {d: [] for d in dims}
    for r in sorted(first.collect(), key=lambda r: (r["dim"], r["level"])):
        d = dims[r["dim"]]
        if r[f"v_{d}"] is not None:
            out[d].append((r[f"v_{d}"], r["level"]))
    return out


def level(value: Column, kind: str, steps: list[tuple[object, int]]) -> Column:
    """The level of a value: that of the last step that it reaches; 0 for null."""
    if not steps:
        return F.lit(0)
    starts = F.array(*[F.lit(v).cast(kind) for v, _ in steps])
    reached = F.size(F.filter(starts, lambda s: s <= value))
    return F.coalesce(F.element_at(F.array(F.lit(0), *[F.lit(k) for _, k in steps]), reached + 1), F.lit(0))


def hilbert(rows: DataFrame, levels: list[str], bits: int = BITS, out: str = "curve") -> DataFrame:
    """rows with the index, on the Hilbert curve, of the point given by the columns `levels` (each 0 to 2^bits - 1)."""
    n, x, flip = len(levels), f"{out}_x", f"{out}_flip"
    turns = F.array(*[F.struct(F.lit(1 << bit).cast("long").alias("high"), F.lit((1 << bit) - 1).cast("long").alias("low"), F.lit(i).alias("axis")) for bit in range(bits - 1, 0, -1) for i in range(n)])

    def turned(at: Column, turn: Column) -> Column:
        """From coarse to fine, each cube is turned so that the curve passes on to the next."""
        is_high = F.get(at, turn["axis"]).bitwiseAND(turn["high"]) != 0
        differ = F.get(at, F.lit(0)).bitwiseXOR(F.get(at, turn["axis"])).bitwiseAND(turn["low"])
        return F.transform(at, lambda v, k: F.when(is_high, F.when(k == 0, v.bitwiseXOR(turn["low"])).otherwise(v)).when((k == 0) | (k == turn["axis"]), v.bitwiseXOR(differ)).otherwise(v))

    rows = rows.withColumn(x, F.aggregate(turns, F.array(*[F.col(c).cast("long") for c in levels]), turned))
    gray = [reduce(Column.bitwiseXOR, [F.get(x, F.lit(k)) for k in range(i + 1)]) for i in range(n)]
    rows = rows.withColumn(x, F.array(*gray))
    ends = [F.when(F.get(x, F.lit(n - 1)).bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(0).cast("long") for bit in range(bits - 1, 0, -1)]
    rows = rows.withColumn(flip, reduce(Column.bitwiseXOR, ends, F.lit(0).cast("long")))
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(F.col(flip)), bit).bitwiseAND(F.lit(1)))
    return rows.withColumn(out, index).drop(x, flip)


def place(rows: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS, law: str = "rows", size: str = "size", bits: int = BITS) -> DataFrame:
    """All columns of rows with curve, shard and slot (the place in the shard, gapless from 0). By the law `rows` shards
    have equal counts, at most one apart; by the law `bytes` equal sums of size, to within the largest row. `ties` order
    rows at one point of the curve."""
    kinds, steps = dict(rows.select(*dims).dtypes), cuts(rows, dims, bits)
    levels = [f"level_{i}" for i in range(len(dims))]
    points = rows.withColumns({c: level(F.col(d), kinds[d], steps[d]) for c, d in zip(levels, dims, strict=True)})
    points = hilbert(points, levels, bits).drop(*levels)
    n = F.lit(shards)
    if law == "rows":
        found = ranked(points, ["curve", *ties])
        shard = F.expr(f"before * {shards} div of")
        start = F.expr(f"({shards} - 1 + shard * of) div {shards}")
        return found.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("before") - start).drop("before", "of")
    if law != "bytes":
        raise ValueError(f"no such law: {law}")
    found = ranked(points, ["curve", *ties], size)
    cut = found.withColumn("shard", F.least(n - 1, F.floor(F.col("before") * n / F.greatest(F.col("of"), F.lit(1)))).cast("int")).drop("of", "before")
    again = ranked(cut, ["shard", "curve", *ties])
    first = again.groupBy("shard").agg(F.min("before").alias("first"))
    return again.join(F.broadcast(first), "shard").withColumn("slot", F.col("before") - F.col("first")).drop("before", "of", "first")


def sizes(text: str = "text") -> dict[str, Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return {"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(F.encode(body, "UTF-8"))}


def write_shards(docs: DataFrame, path: str, dims: list[str] = ("source", "lang", "size"), shards: int = SHARDS, law: str = "bytes") -> None:
    """Write all columns of docs to Parquet below path, a folder for each shard, rows in the order of the curve: shards are
    ruled out by folder, files and row groups by the minima and maxima of the dimensions. Dimensions are columns of docs or
    `size`, the bytes of the text."""
    own = {d: (F.col("size") if d == "size" else F.col(f"row.`{d}`")) for d in dims}
    rows = docs.select(as_row(docs), *[c.alias(n) for n, c in sizes().items()]).withColumns({f"dim_{d}": c for d, c in own.items()})
    placed = place(rows, [f"dim_{d}" for d in dims], ["text_crc32", "size"], shards, law)
    n = max(shards, shuffle_partitions(docs.sparkSession))
    dealt = placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at most one apart: that law holds whatever the texts' lengths; write_shards() evens out bytes instead."""
    docs = table(spark, sf_dir, "documents")

    def make() -> DataFrame:
        # texts are read once, for their sizes and checksums; all further passes are over these few columns
        rows = save(docs.select("doc_id", "source", "lang", *[c.alias(n) for n, c in sizes().items()]), "sizes")
        placed = place(rows, ["source", "lang", "size"], ["text_crc32", "doc_id"])
        return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

    return settled("op13", make)


def _sql() -> str:
    dims, top = ["source", "lang", "size"], 1 << BITS
    step = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    parts = [f"""WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda acc, k: {step}) AS v FROM range(256) r(i))),
docs AS (SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 1 AS size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32
  FROM documents, crc)"""]
    for d in dims:
        parts.append(f"levels_{d} AS (SELECT v, CAST((before * {top}) // of AS BIGINT) AS level FROM (SELECT v, sum(n) OVER (ORDER BY v NULLS FIRST) - n AS before, sum(n) OVER () AS of FROM (SELECT {d} AS v, count(*) AS n FROM docs GROUP BY 1)))")
    joins = " ".join(f"LEFT JOIN levels_{d} l{i} ON l{i}.v IS NOT DISTINCT FROM docs.{d}" for i, d in enumerate(dims))
    parts.append(f"h0 AS (SELECT docs.*, {', '.join(f'l{i}.level AS x{i}' for i in range(3))} FROM docs {joins})")
    k = 0
    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(3):
            differ = f"(xor(x0, x{i}) & {low})"
            new = [f"CASE WHEN x{i} & {1 << bit} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {differ}) END AS x0"]
            if i:
                new.append(f"CASE WHEN x{i} & {1 << bit} <> 0 THEN x{i} ELSE xor(x{i}, {differ}) END AS x{i}")
            parts.append(f"h{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM h{k})")
            k += 1
    parts.append("g AS (SELECT * REPLACE (xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2) FROM h" + str(k) + ")")
    flip = "0"
    for bit in range(BITS - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x2 & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    parts.append(f"f AS (SELECT *, {flip} AS flip FROM g)")
    bits = [f"((xor(x{i}, flip) >> {bit}) & 1) << {3 * bit + 2 - i}" for bit in range(BITS - 1, -1, -1) for i in range(3)]
    parts.append(f"c AS (SELECT *, {' + '.join(f'({b})' for b in bits)} AS curve FROM f)")
    parts.append("r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS before, count(*) OVER () AS of FROM c)")
    parts.append(f"s AS (SELECT *, (before * {SHARDS}) // of AS shard FROM r)")
    return ",\n".join(parts) + f"\nSELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(before - ({SHARDS - 1} + shard * of) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"


OP13_SQL = _sql()
