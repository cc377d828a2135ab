"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line (text between newlines, trimmed and lower-cased) is the set of its shingles: the hashes of
all runs of ``SHINGLE`` bytes of its UTF-8, or of the whole line if it is shorter. Its signature has
the least hash in each of ``BINS`` equal ranges of hash values (one-permutation MinHash: each shingle is
hashed once, and one aggregation of conditional minima gives the whole signature). ``BANDS`` bands of
neighbouring bins are the keys under which lines meet. Under a key, a line is first compared with the least
line of the key and with the one before it: as many candidates as lines, however many meet. Lines of
a key that are then in several components meet again until each pair of the key is compared or connected.
Candidates whose signatures agree in ``AGREE`` bins or more (by ``BITS`` bits of each) are verified by the exact
Jaccard similarity of their shingle sets (``P`` / ``Q`` or more), and distributed union-find makes
components of the verified pairs. Of each component the first occurrence, by doc_id and line number,
stays.

Sets are compared in two steps. Each line has ``64 * WORDS`` marks, the parities of the numbers of its shingles
whose hashes fall on each mark. Where the marks of two lines differ, one set at least has a shingle that the other has not: sets with
more different marks than a similarity of ``P`` / ``Q`` allows shingles in one set only can't be similar, which drops no
similar pair. The shingles themselves are compared for the pairs that are left.

Lines above ``SHORT`` bytes look for their minima in the lowest quarter of each range, where nearly all are.

Banding misses a pair at the very threshold with a probability of (1 - J^2)^5 or 0.6 %, agreement in
fewer bins than ``AGREE`` happens to 0.1 % of such pairs, and both are rarer above the threshold.
Equal lines are one line from the start and always found.

Empty lines always stay. Null texts have no lines. Rows that repeat with their doc_id have their
lines at the same places: both rows keep or lose a line alike. Null doc_ids come first. Other
columns play no part, and dedup_lines() keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, store, tidy
from .components import connected_components

SHINGLE = 9
BANDS, ROWS = 5, 2
BINS = BANDS * ROWS
AGREE, BITS = 5, 6
P, Q = 4, 5
#: Lines whose ids may be broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Lines of a key that a task pairs with each other, and pairs a line under which all pairs are made at once.
BLOCK = 1000
FEW_PAIRS = 20
#: Words of 64 marks of a line, and the columns of a line's size and marks.
WORDS = 16
SIZE_AND_MARKS = ["size", *(f"m{k}" for k in range(WORDS))]

#: Bins of the upper halves of hashes.
WIDTH = (1 << 32) // BINS
_LIMITS = [-(1 << 31) + k * WIDTH for k in range(BINS)] + [1 << 31]
#: Lines of more bytes than SHORT look for minima in the lowest of LOWEST parts of each range, and among their FIRST shingles.
SHORT, LOWEST, FIRST = 96, 4, 16


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.replace(line, F.lit("\r"), F.lit(" "))))


def shingles(data: Column) -> Column:
    """The hashes of all shingles of a line's UTF-8, repeated ones included."""
    starts = lambda line: F.sequence(F.lit(1), F.greatest(F.octet_length(line) - (SHINGLE - 1), F.lit(1)))
    # A function over an array reads a binary column anew, with a copy of the whole line, for each shingle; its own variable is copied once.
    return F.transform(F.array(data), lambda line: F.transform(starts(line), lambda at: F.xxhash64(F.substring(line, at, F.lit(SHINGLE)))))[0]


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line (normal form) of all lines that are not empty."""
    # No array here is empty; for explode() without _outer Spark makes each one twice, to filter empty ones.
    lines = documents.where("text IS NOT NULL").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    # Lines of blanks are empty in normal form; tested so, no line is brought into that form twice.
    return lines.where(F.ltrim("raw", F.lit(" \r")) != "").select("doc_id", "line_no", normal_line(F.col("raw")).alias("line"))


def _signatures(lines: DataFrame) -> DataFrame:
    """line_id and the minima bin0, bin1, ... (null: empty) of each distinct line."""
    data = lines.select(F.xxhash64("line").alias("line_id"), F.col("line").cast("binary").alias("data"), (F.octet_length("line") <= SHORT).alias("short"))
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("data") - (SHINGLE - 1), F.lit(1)))
    hashes = data.select("line_id", "data", "short", F.explode_outer(starts).alias("at")).select("line_id", (F.col("short") | (F.col("at") <= FIRST)).alias("always"), F.shiftright(F.xxhash64(F.substring("data", F.col("at"), F.lit(SHINGLE))), 32).cast("int").alias("h"))
    h = F.col("h")
    # Of a longer line only the lowest part of each range counts: nearly all minima lie there, and the rest need no aggregation.
    # Its first shingles always count, since a line that repeats itself may have no other.
    hashes = hashes.where(F.col("always") | ((h.cast("long") + (1 << 31)) % WIDTH < WIDTH // LOWEST))
    return hashes.groupBy("line_id").agg(*[F.min(F.when((h >= low) & (h < high), h)).alias(f"bin{k}") for k, (low, high) in enumerate(zip(_LIMITS, _LIMITS[1:], strict=False))])


def _keyed(signatures: DataFrame) -> DataFrame:
    """line_id, sketch (BITS bits of each bin) and key, for each band of a line that isn't empty."""
    bins = [F.col(f"bin{k}") for k in range(BINS)]
    sketch = F.lit(0).cast("long")
    for c in bins:
        # Minima lie low in their ranges: their hashes are spread, their values aren't.
        sketch = F.shiftleft(sketch, BITS).bitwiseOR(F.when(c.isNotNull(), F.hash(c).bitwiseAND(F.lit((1 << BITS) - 1)).cast("long")).otherwise(F.lit(0).cast("long")))
    bands = [F.when(F.coalesce(*bins[b * ROWS : (b + 1) * ROWS]).isNotNull(), F.xxhash64(F.lit(b), *[F.coalesce(c, F.lit(0)) for c in bins[b * ROWS : (b + 1) * ROWS]])) for b in range(BANDS)]
    return signatures.select("line_id", sketch.alias("sketch"), F.explode(F.array(*bands)).alias("key")).where("key IS NOT NULL")


def _agree(a: Column, b: Column) -> Column:
    """In how many bins two sketches agree: the lowest bit of each bin gathers its other bits that differ."""
    apart = a.bitwiseXOR(b)
    some, reach = apart, 1
    while reach < BITS:
        step = min(reach, BITS - reach)
        some, reach = some.bitwiseOR(F.shiftright(some, step)), reach + step
    return F.lit(BINS) - F.bit_count(some.bitwiseAND(F.lit(sum(1 << BITS * k for k in range(BINS)))))


def _met(lines: DataFrame) -> DataFrame:
    """line_id, sketch, key, least and before (structs of the two) and the number of lines, for keys of two lines or more."""
    keys = Window.partitionBy("key")
    order, this = keys.orderBy("line_id"), F.struct("line_id", "sketch")
    return _keyed(_signatures(lines)).select("*", F.lag(this).over(order).alias("before"), F.first(this).over(order).alias("least"), F.count("*").over(keys).alias("many")).where("many > 1")


def _candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each line with the least line of its key and the one before it, if their sketches agree enough."""
    pairs = met.where("before IS NOT NULL").select(F.col("line_id").alias("a"), "sketch", F.explode(F.array("before", "least")).alias("other"))
    return pairs.where(_agree(F.col("sketch"), F.col("other.sketch")) >= AGREE).select("a", F.col("other.line_id").alias("b")).distinct()


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """line_id and data (UTF-8) of the lines named, each from the first of its rows: few lines need no shuffle of texts."""
    ids = store(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    rows = lines.select("line_id", "row").join(F.broadcast(ids) if few else ids, "line_id").groupBy("line_id").agg(F.min("row").alias("row"))
    return store(lines.join(F.broadcast(rows) if few else rows, ["line_id", "row"]).select("line_id", F.col("line").cast("binary").alias("data")))


def _marks(texts: DataFrame) -> DataFrame:
    """line_id, size (number of different shingles) and the words of marks m0, m1, ... of each line."""
    # The array is made in a step of its own: Spark compiles explode() of a column, not of a function over an array.
    hashes = texts.select("line_id", F.array_distinct(shingles(F.col("data"))).alias("all")).select("line_id", F.explode_outer("all").alias("h"))
    words = hashes.select("line_id", F.col("h").bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))").alias("bit"))
    none = F.lit(0).cast("long")
    return words.groupBy("line_id").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(none)).alias(f"m{k}") for k in range(WORDS)])


def _near(x: str, y: str) -> Column:
    """Can lines x and y (prefixes of their columns) be similar? Each different mark is a shingle that only one of them has."""
    apart = F.lit(0)
    for m in SIZE_AND_MARKS[1:]:
        apart = apart + F.bit_count(F.col(x + m).bitwiseXOR(F.col(y + m)))
    return apart * (P + Q) <= _both(x, y) * (Q - P)


def _both(x: str, y: str) -> Column:
    return F.col(f"{x}size") + F.col(f"{y}size")


def _placed(rows: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """The rows of lines with their component (the line itself if it has none) as column ``name``."""
    found = components.toDF("line_id", "_component")
    found = rows.join(F.broadcast(found) if components.count() <= BROADCAST_IDS else found, "line_id", "left")
    return found.withColumn(name, F.coalesce("_component", "line_id")).drop("_component")


def _with_ends(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs with the columns of their lines a (x_...) and b (y_...); few pairs choose the rows that are shuffled."""
    a, b = (lines.select(F.col("line_id").alias(end), *[F.col(c).alias(p + c) for c in lines.columns if c != "line_id"]) for end, p in (("a", "x_"), ("b", "y_")))
    if pairs.count() > BROADCAST_IDS:
        return pairs.join(a, "a").join(b, "b")
    return a.join(F.broadcast(pairs), "a").join(b.join(F.broadcast(pairs.select("b").distinct()), "b"), "b")


def _near_pairs(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and both (the sum of their sizes) of the pairs that can be similar."""
    return _with_ends(pairs, marks).where(_near("x_", "y_")).select("a", "b", _both("x_", "y_").alias("both"))


def _similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, both) whose shingle sets have a Jaccard similarity of P / Q or more."""
    common = F.size(F.array_intersect(shingles(F.col("x_data")), shingles(F.col("y_data"))))
    return _with_ends(pairs, texts).where(common * (P + Q) >= F.col("both") * P).select("a", "b")


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with the size and the marks of their line; few rows need no shuffle of marks."""
    return marks.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, "line_id")


def _all_pairs(rest: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b, both) under a key that are in two components, whose sketches agree enough and that can be similar; keys of many lines are dealt out by pairs of blocks. A pair comes from the least of its keys only."""
    keys = F.collect_list("key").over(Window.partitionBy("line_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    rows = _marked(store(rest.drop("pivot", "own").withColumn("less", keys).withColumn("less", F.when(F.size("less") > 0, F.col("less")))), marks)
    rows = rows.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("line_id", F.lit(BLOCK)), F.col("blocks")).cast("int"))
    # A line goes to each pair of blocks that has its own, once: both sides of the join are one shuffle.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # None of the numbers is null; where Spark knows that, the code of the join is short enough to be compiled well.
    known = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("line_id", "sketch", "component", "before", *SIZE_AND_MARKS)]
    dealt = rows.select("*", other.alias("other")).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.coalesce("block", F.lit(0)).alias("block"), "less", *known)
    x, y = dealt.alias("x"), dealt.alias("y")
    place = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    in_order = ((F.col("x.block") < F.col("y.block")) | ((F.col("x.block") == F.col("y.block")) & (F.col("x.line_id") < F.col("y.line_id")) & (F.col("x.i") == F.col("x.j"))))
    new = in_order & (F.col("x.component") != F.col("y.component"))
    met = (F.col("x.before") == F.col("y.line_id")) | (F.col("y.before") == F.col("x.line_id"))
    again = F.coalesce(F.arrays_overlap("x.less", "y.less"), F.lit(False))
    both = x.join(y, place[0] & place[1] & place[2] & new & ~met & (_agree(F.col("x.sketch"), F.col("y.sketch")) >= AGREE) & _near("x.", "y.") & ~again)
    return both.select(F.greatest("x.line_id", "y.line_id").alias("a"), F.least("x.line_id", "y.line_id").alias("b"), _both("x.", "y.").alias("both"))


def _join_rest(met: DataFrame, pairs: DataFrame, texts: DataFrame, marks: DataFrame, links: DataFrame) -> DataFrame:
    """Components when all pairs under a key are verified or already connected.

    ``met`` has the lines of keys of four or more (fewer have all their pairs in ``pairs``). Lines of a
    key in several components meet again: all with one line of the key, another in each round, as long
    as that halves the pairs left and they are many; then all pairs of two components.
    """
    rest, turn, before = met.where("line_id <> least.line_id").select("key", "line_id", "sketch", F.col("before.line_id").alias("before")), 0, math.inf
    keys, own = Window.partitionBy("key"), Window.partitionBy("key", "component")
    while True:
        components = connected_components(links)
        pivot = F.min(F.struct(F.xxhash64("line_id", F.lit(turn)).alias("turn"), "line_id", "sketch", "component")).over(keys)
        spread = _placed(rest, components, "component").select("*", F.count("*").over(keys).alias("many"), pivot.alias("pivot")).select("*", F.count("*").over(own).alias("own"))
        now = store(spread.where("own < many"))
        lines, load = now.agg(F.count("*"), F.sum((F.col("many") - F.col("own")).cast("double"))).first()
        if not lines:
            return components
        last = load <= FEW_PAIRS * lines or load > before / 2
        if last:
            fresh = _all_pairs(now, marks)
        else:
            met_again = now.where((F.col("component") != F.col("pivot.component")) & (_agree(F.col("sketch"), F.col("pivot.sketch")) >= AGREE))
            fresh = _near_pairs(marks, store(met_again.select(F.greatest("line_id", "pivot.line_id").alias("a"), F.least("line_id", "pivot.line_id").alias("b")).distinct()))
            rest = now.where("line_id <> pivot.line_id").select("key", "line_id", "sketch", "before")
        fresh = store(fresh.join(pairs, ["a", "b"], "left_anti"))
        more = store(_similar(texts, fresh))
        links = links.union(more)
        if last:
            return components if more.isEmpty() else connected_components(links)
        pairs, turn, before = pairs.union(fresh.select("a", "b")), turn + 1, load


@tidy
def dropped_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines that go."""
    lines = store(lines_of(documents.select("doc_id", "text")).withColumn("line_id", F.xxhash64("line")).withColumn("row", F.monotonically_increasing_id()))
    places = lines.select("doc_id", "line_no", "line_id")
    met = store(_met(lines))
    pairs = store(_candidates(met))
    large = met.where("many > 3")
    texts = _texts(lines, pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).union(large.select("line_id")))
    marks = store(_marks(texts))
    links = store(_similar(texts, store(_near_pairs(marks, pairs))))
    places = _placed(places, _join_rest(large, pairs, texts, marks, links), "line").select("doc_id", "line_no", "line")
    repeated = store(places.groupBy("line").agg(F.count("*").alias("many")).where("many > 1").select("line"))
    few = repeated.count() <= BROADCAST_IDS
    places = places.join(F.broadcast(repeated) if few else repeated, "line")
    firsts = store(places.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    return places.join(F.broadcast(firsts) if few else firsts, "line").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))).select("doc_id", "line_no").distinct()


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (their numbers, ascending) for every row."""
    drops = dropped_lines(documents).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("dropped_lines"))
    rows = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    out = rows.join(drops.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.coalesce("dropped_lines", F.array().cast("array<int>"))
    return out.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size(none).cast("long").alias("n_dropped"), none.alias("dropped_lines"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose text has lost the lines that go."""
    drops = dropped_lines(documents).groupBy(F.col("doc_id").alias("_lattix_id")).agg(F.collect_list("line_no").alias("_lattix_drops"))
    rows = documents.join(drops, F.col("doc_id").eqNullSafe(F.col("_lattix_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_lattix_drops", i)), "\n")
    text = F.when(F.col("_lattix_drops").isNull(), F.col("text")).otherwise(kept).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))
