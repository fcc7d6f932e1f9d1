"""Mixing sources to target weights by entropy balancing.

Every source is to give a target number of words. Of all rates r (copies of a
document) that meet the targets with no rate above ``most``, those are taken
that are nearest to one copy of each document, by the sum of r ln r - r + 1
over documents. Their dual is convex, with one multiplier for each source, and
gives rates that are tilted exponentially by a document's size,
r = min(most, exp(theta * size / mean)). Newton steps on the logarithm of a
source's words find theta for all sources at once: each step is one aggregate
over the table of (source, size, documents), which is counted before and whose
rows do not grow with the number of documents of a size. A step that leaves the
bracket found so far is replaced by halving it. Sums are decimal, so they do not
depend on the order of rows, and reruns agree.

Rates become copies by order sampling: the whole part of a rate is taken, and
for what is left a document stands at draw / fraction, where draw is a hash of
its id and text in (0, 1). Documents are taken in that order while they fit into
what their source has left. The place is found by counting words in ranges of
the order, then in ranges of the range where they cease to fit, then document
by document, so no group of documents is gathered anywhere. What is left then,
less than one document, is filled up from documents further on, first from
those of an eighth of it at most, then from those that fit at all. No source
gets more than its target by more than rounding.

Targets: sources in code point order, null last, weigh ``weights``, repeated;
they share the words of all documents, none above ``most`` times its own. What
is above is shared again by weight. The level is where this ends: the sources
in order of their limit by weight, as many at their limit as the level exceeds.
The table with a row for each source is put in order by single tasks; it is
sent to other tasks up to ``BROADCAST_SOURCES`` rows and joined by shuffle above.

Defined results: null and empty texts and texts of white space have size 0 and
nothing is taken from them. A null source is a source. If all sizes are 0 so are
the targets. Rows that repeat an id and a text are taken alike. A null id is an
id; the id is only hashed and carried. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, table, written

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Times its size that a document or source gives at most.
MOST = 3
#: Share of the target within which Newton's steps end; order sampling makes up the rest.
NEAR = 1e-6
MAX_STEPS = 200
#: Ranges of a level of the order.
RANGES = 4096
#: Rounds of order sampling: the first takes any document, later ones those of at most this share of what is left.
FITTED = (None, 1 / 8, 1)
BROADCAST_SOURCES = 100_000
_SUM = "decimal(32,6)"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, draw) of every row: its words, and a hash of id and text in (0, 1)."""
    text = F.col(text_col)
    draw = (F.xxhash64(F.col(id_col).cast("string"), text).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw"))


def _each(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """``df`` with the columns of its source."""
    right = by_source.withColumnRenamed("source", "_source")
    small = by_source.count() <= BROADCAST_SOURCES
    return df.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, mean, target) from (source, size, n): what each source is to give."""
    own = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum((F.col("n") * F.col("size")).cast("decimal(30,0)") * F.col("size")).cast("double").alias("square"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    own = own.withColumn("weight", weight)
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * most
    over = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    level = over / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    own = own.withColumn("level", level).withColumn("full", limit <= F.col("weight") * F.col("level"))
    # levels rise while sources are filled up; the first that is not decides
    last = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.when(F.col("full"), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("weight") * last))
    mean = F.coalesce(F.try_divide("square", "source_size"), F.lit(1.0))
    return own.select("source", "source_size", mean.alias("mean"), F.coalesce(target, F.lit(0.0)).alias("target"))


def _rate(theta: Column, most: int) -> Column:
    """Copies of a document of a source with this multiplier; null where all documents are at their limit."""
    return F.when(theta.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(theta * F.col("size") / F.col("mean"), F.lit(64.0)))))


def balance(counted: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """``goals`` with theta, the multiplier whose tilted rates give each source its target: Newton steps over (source, size, n)."""
    size = F.col("size")
    never = (F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))
    state = written(goals.withColumn("theta", F.when(~never, F.lit(0.0))).withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("done", never), "dual")
    for _ in range(MAX_STEPS):
        if not state.filter("not done").head(1):
            return state.drop("lo", "hi", "done")
        rate = _rate(F.col("theta"), most)
        words = (F.col("n") * size).cast("double") * rate
        slope = F.when(rate < most, words * size / F.col("mean")).otherwise(F.lit(0.0))
        now = _each(counted, state.filter("not done").select("source", "theta", "mean")).groupBy("source").agg(F.sum(words.cast(_SUM)).cast("double").alias("words"), F.sum(slope.cast(_SUM)).cast("double").alias("slope"))
        now = now.withColumnRenamed("source", "_source")
        theta, gap = F.col("theta"), F.log(F.greatest(F.col("words"), F.lit(1e-6))) - F.log("target")
        step = state.join(now, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("gap", gap)
        step = step.withColumn("lo", F.when(F.col("gap") < 0, theta).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, theta).otherwise(F.col("hi")))
        newton = theta - F.try_divide(F.col("gap") * F.col("words"), F.col("slope"))
        wide = theta - F.signum("gap") * F.greatest(F.abs(theta), F.lit(1.0))
        halved = F.coalesce((F.col("lo") + F.col("hi")) / 2, wide)
        inside = F.coalesce((newton > F.coalesce("lo", F.lit(float("-inf")))) & (newton < F.coalesce("hi", F.lit(float("inf")))) & (F.abs(newton - theta) <= 2 * F.greatest(F.abs(theta), F.lit(1.0))), F.lit(False))
        ended = (F.abs(F.col("gap")) <= NEAR) | (F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.abs(theta), F.lit(1e-3)))
        live = ~F.col("done") & ~F.coalesce(ended, F.lit(False))
        step = step.withColumn("next", F.when(live, F.when(inside, newton).otherwise(halved)).otherwise(theta)).withColumn("done", ~live)
        before, state = state, written(step.select(*goals.columns, F.col("next").alias("theta"), "lo", "hi", "done"), "dual")
        forget(before)
    raise RuntimeError("the multipliers of some sources were not found")


def _beside(df: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables with a row for each source side by side; rows of ``df`` stay without a partner."""
    return df.join(other.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _crossing(counts: DataFrame, left: DataFrame, by: str) -> DataFrame:
    """(source, by, left) of each source's row, in the order of ``by``, with which the words first exceed what is left; ``left`` then is what is left before it."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _each(counts.withColumn("before", before), left).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    return out.select("source", by, (F.col("left") - F.col("before")).alias("left"))


def filled(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(source, last, left): the place up to which the documents of ``rows`` (source, place, size) fit into what is ``left`` (source, left), and what is left then."""
    fine = F.floor(F.col("place") * (RANGES * RANGES))
    rows = rows.select("source", "place", "size", F.floor(fine / RANGES).alias("coarse"), (fine % RANGES).alias("fine"))
    words = F.sum("size").alias("words")
    counts = written(rows.groupBy("source", "coarse").agg(words), "coarse-words")
    first = written(_crossing(counts, left, "coarse"), "coarse")
    at = _each(rows, first.withColumnRenamed("coarse", "at")).filter(F.col("coarse") == F.col("at")).drop("left", "at")
    second = written(_crossing(at.groupBy("source", "fine").agg(words), first.select("source", "left"), "fine"), "fine")
    near = _each(at, second.select("source", F.col("fine").alias("at"), F.col("left"))).filter(F.col("fine") == F.col("at"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = near.groupBy("source", "place").agg(words, F.max("left").alias("room")).withColumn("upto", upto).filter("upto <= room")
    start = (F.col("coarse") * RANGES + F.col("fine")) / (RANGES * RANGES) * (1 - 2.0**-52)  # just before the range
    inside = _beside(_beside(second, first.drop("left")), fits.groupBy("source").agg(F.max("place").alias("last"), F.max("upto").alias("upto")))
    inside = inside.select("source", F.coalesce("last", start).alias("last"), (F.col("left") - F.coalesce("upto", F.lit(0))).alias("rest"))
    total = counts.groupBy("source").agg(F.sum("words").alias("total"))
    everything = F.when(F.col("left") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))  # no range exceeds what is left: all fit, or nothing is left
    out = _beside(_beside(left, inside), total)
    rest = F.coalesce("rest", F.when(F.col("left") > 0, F.col("left") - F.coalesce("total", F.lit(0))).otherwise(F.col("left")))
    out = written(out.select("source", F.coalesce("last", everything).alias("last"), rest.alias("left")), "filled")
    forget(counts, first, second)
    return out


def copies(rated: DataFrame, goals: DataFrame) -> DataFrame:
    """``rated`` (source, size, rate, draw) with the whole number of copies of each document."""
    rated = rated.withColumn("copies", F.floor("rate").cast("int")).withColumn("fraction", F.col("rate") - F.floor("rate"))
    draw = F.try_divide("draw", "fraction")
    rated = rated.withColumn("place", F.when((F.col("fraction") > 0) & (F.col("size") > 0), draw / (1 + draw)))
    whole = rated.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("whole"))
    left = written(_beside(goals.select("source", "target"), whole).select("source", F.round(F.col("target") - F.col("whole")).cast("long").alias("left")), "left")
    for share in FITTED:
        limit = F.col("left") * share
        fit = (F.col("place").isNotNull()) & ((F.col("size") <= limit) if share else F.lit(True))
        rows = _each(rated, left).filter(fit).select("source", "place", "size")
        got = filled(rows, left)
        here = _each(rated, _beside(left, got.select("source", "last")))
        more = F.coalesce(fit & (F.col("place") <= F.col("last")), F.lit(False))
        rated = here.withColumn("copies", F.col("copies") + more.cast("int")).withColumn("place", F.when(~more, F.col("place"))).drop("left", "last")
        left = got.select("source", "left")
    off = F.abs(F.col("size") - F.col("left"))  # one more document, if that brings the source nearer
    nearer = _each(rated, left).filter(F.col("place").isNotNull() & (off < F.col("left"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("one"))
    one = written(_beside(left.select("source"), nearer.select("source", F.col("one.place").alias("one"))), "one")
    last = _each(rated, one)
    return last.withColumn("copies", F.col("copies") + F.coalesce((F.col("place") == F.col("one")).cast("int"), F.lit(0))).drop("fraction", "place", "one")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken) of every row."""
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    counted = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counted")
    goals = balance(counted, targets(counted, weights, most), most)
    rated = _each(sized, goals).withColumn("rate", _rate(F.col("theta"), most))
    out = copies(rated, goals).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", "draw")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
