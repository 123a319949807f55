"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A source of size S and target T takes floor(T / S) certain
copies of each of its documents; T - S * floor(T / S) words are left to draw. In the draw, a document
has inclusion odds p = min(1, c * weight), where weight is its length to the power `lean`, by half
octaves of length, and c makes the expected words of the draw equal to what is left. Documents with p
of 1 are certain; the others are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and taken in that order until the words are used up: a sample of fixed size with unequal odds within
and between sources. u is a hash of the document id, so reruns agree.

Rows of equal id, source and size are one group of so many documents, so repeated rows share a rank
and are drawn one by one. The cut is found without sorting a source: ranks fall into bins, words are
summed by source and bin (combined map-side), and the bin where the cut lies is binned again until it
holds few groups; only those are ordered. From the first document that does not fit, the draw goes on
along the order and takes every later one that still fits. What is left then is less than any undrawn
document; the smallest of them is taken too if that brings the source nearer to its target. So a
source misses its target by half its smallest undrawn document at most.

Of equal sizes the draw takes the first in order, gap / size of them at most. These are all that the
pass after the cut can take: about gap * log(gap) groups a source, and those in a bin with the last.
Sources themselves are ordered in one task, a row a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
null id hashes like any value; ties of rank go by id, then size; a source of size 0 has target 0;
repeated rows are documents of their own; extra columns are kept aside.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relata.llm.common import prepare, settle

#: Fixed value: a word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a source's ranks in a round, and groups of the last bin that one task orders.
BINS, EDGE = 1024, 4096
#: The power of a document's length that its odds in the draw follow.
LEAN = 0.5


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(total: Column, cap: str, weight: str, ties: str, *by: str) -> Column:
    """The level at which the sum of min(cap, level * weight) over rows (of each `by`) is total.

    Rows ordered by cap / weight are capped up to some point; prefix sums give the level for each point
    at once. It rises with the point until the first row that need not be capped, then falls: the largest holds.
    """
    order = W.partitionBy(*by).orderBy(F.col(cap) / F.col(weight), F.col(ties).asc_nulls_last())
    capped = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return (total - capped) / F.sum(weight).over(order.rowsBetween(0, W.unboundedFollowing))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Targets that share the total size by weight, none above `most` times its source's size.

    sources: a row a source with its size. The excess of capped sources is shared again by weight.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sources.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("point", _level(F.col("total"), "cap", "weight", "source"))
    return s.withColumn("level", F.max("point").over(everything)).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _class(size: Column) -> Column:
    return F.floor(2 * F.log2(F.greatest(size, F.lit(1)))).cast("int")


def _fill(rows: pa.Table) -> pa.Table:
    """Candidates of one source: those that fit are drawn in order, then one of the smallest if that comes nearer."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("v", "doc_id", "size")], null_placement="at_start"))
    gap, sizes, n, drawn = rows["gap"][0].as_py(), rows["size"].to_pylist(), rows["n"].to_pylist(), rows["drawn"].to_pylist()
    for i, size in enumerate(sizes):
        more = min(n[i] - drawn[i], int(gap // size))
        drawn[i], gap = drawn[i] + more, gap - more * size
    i = min((i for i in range(len(n)) if drawn[i] < n[i]), key=sizes.__getitem__, default=None)
    if i is not None and sizes[i] < 2 * gap:
        drawn[i] += 1
    return rows.set_column(rows.schema.get_field_index("drawn"), rows.schema.field("drawn"), pa.array(drawn, pa.int64()))


def _of_source(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """df with the other's columns for its source; null is a source."""
    other = other.withColumnRenamed("source", "_source")
    return df.join(other, df.source.eqNullSafe(other._source), how).drop("_source")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), words_in(docs[text_col]).alias("size")]


def _drawn(slim: DataFrame, weights: tuple[int, ...], most: float, lean: float, seed: int) -> DataFrame:
    """A row a group of documents (doc_id, source, size): n, source_size, target, whole, drawn."""
    sources = settle(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    classes = slim.where("size > 0").groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").cast("double").alias("words"))
    classes = _of_source(classes, sources.select("source", "left")).withColumn("w", F.pow(F.lit(2.0), F.col("class") * lean / 2)).withColumn("ww", F.col("w") * F.col("words"))
    classes = classes.withColumn("point", _level(F.col("left"), "words", "ww", "class", "source"))
    odds = classes.withColumn("level", F.max("point").over(W.partitionBy("source"))).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level") * F.col("w"))))
    odds = settle(odds.select("source", "class", "p", "words"), "odds")  # at most some sixty rows a source

    groups = _of_source(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), sources).withColumn("class", _class(F.col("size")))
    mine = odds.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "p")
    groups = groups.join(mine, groups.source.eqNullSafe(mine._s) & (groups["class"] == mine._c), "left").drop("_s", "_c", "class")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    v = F.when((F.col("size") > 0) & (F.col("p") > 0), F.when(F.col("p") >= 1, -1.0).otherwise(rank / (1 + rank)))  # -1: certain; null: never
    ranked = settle(groups.withColumn("v", v).drop("p"), "ranked")

    certain = odds.where("p >= 1").groupBy("source").agg(F.sum("words").alias("before"))
    spans = _of_source(sources.where("left > 0").select("source", "left"), certain, "left").select("source", "left", F.coalesce("before", F.lit(0.0)).alias("before"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    while True:
        inside = _of_source(ranked.where("v >= 0").select("source", "v", "size", "n"), spans).where("v >= low and v < low + width")
        bins = inside.groupBy("source", "left", "before", "low", "width", F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS).cast("int").alias("bin"))
        bins = bins.agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"))
        run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS rows a source
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        cut = bins.where("before + words > left").groupBy("source").agg(F.min_by(F.struct("left", "before", (F.col("low") + F.col("bin") * F.col("width") / BINS).alias("low"), (F.col("width") / BINS).alias("width"), "rows"), "bin").alias("cut"))
        spans = settle(cut.select("source", "cut.*"), "spans")
        most_rows, width = spans.agg(F.max("rows"), F.min("width")).first()
        if most_rows is None or most_rows <= EDGE or width < 2.0**-48:
            break
    marked = _of_source(ranked, spans.select("source", "before", "low", "width"), "left")
    edge = marked.where("v >= low and v < low + width")
    words = F.col("size") * F.col("n")
    run = W.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("left") - F.col("before") - F.coalesce(F.sum(words).over(run), F.lit(0))
    edge = edge.withColumn("drawn", F.greatest(F.lit(0), F.least("n", F.floor(room / F.col("size")))).cast("long"))
    rest = marked.where("low is null or v is null or v < low or v >= low + width")
    rest = rest.withColumn("drawn", F.when(F.col("v").isNotNull() & (F.col("low").isNull() | (F.col("v") < F.col("low"))), F.col("n")).otherwise(0).cast("long"))
    out = settle(edge.unionByName(rest).drop("before", "low", "width"), "drawn")

    gaps = out.where("left > 0").groupBy("source").agg((F.max("left") - F.sum(F.col("size") * F.col("drawn"))).alias("gap"))
    near = settle(_of_source(out, gaps, "left"), "gaps")
    open_ = F.coalesce(F.col("v").isNotNull() & (F.col("drawn") < F.col("n")) & (F.col("size") < 2 * F.col("gap")), F.lit(False))
    bin_ = F.floor(F.col("v") * BINS).cast("int")
    per_bin = near.where(open_).groupBy("source", "size", "gap", bin_.alias("bin")).agg(F.sum(F.col("n") - F.col("drawn")).alias("m"))
    earlier = W.partitionBy("source", "size").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS rows a size
    per_bin = per_bin.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    # one more of each size than can fit, for the last document
    last = per_bin.where("earlier <= floor(gap / size)").groupBy("source", "size").agg(F.max("bin").alias("last"))
    last = settle(last.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z"), "last")
    met = near.join(last, near.source.eqNullSafe(last._s) & (near["size"] == last._z), "left").withColumn("may", F.coalesce(open_ & (bin_ <= F.col("last")), F.lit(False)))
    met = settle(met.drop("last", "_s", "_z"), "met")
    filled = met.where("may").drop("may").groupBy("source").applyInArrow(_fill, near.schema)
    return settle(filled.unionByName(met.where("not may").drop("may")).select("doc_id", "source", "size", "n", "source_size", "target", "whole", "drawn"), "groups")


def _dealt(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """rows with copies, by their group; names: rows' columns of id, source and size.

    In a group that is drawn in part, as many rows get one more as are drawn: rows are numbered within
    the files that hold them, and files by running counts, so no task sees a whole group.
    """
    key, mine = [F.col(n) for n in names], ["_g_id", "_g_source", "_g_size"]
    renamed = groups.withColumnsRenamed(dict(zip(("doc_id", "source", "size"), mine, strict=True)))
    same = [k.eqNullSafe(F.col(m)) for k, m in zip(key, mine, strict=True)]
    even = rows.join(renamed.where("drawn = 0 or drawn = n"), same).withColumn("copies", F.col("whole") + (F.col("drawn") > 0).cast("long"))
    partly = settle(renamed.where("drawn > 0 and drawn < n"), "partly")
    if partly.isEmpty():
        return even.drop(*mine)
    odd = settle(rows.join(partly, same).withColumn("_file", F.spark_partition_id()), "odd")
    counts = odd.groupBy(*mine, "_file").agg(F.count("*").alias("_m"))
    counts = counts.withColumn("_from", F.coalesce(F.sum("_m").over(W.partitionBy(*mine).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(*(F.col(c).alias("_" + c) for c in (*mine, "_file")), "_from")
    odd = odd.withColumn("_number", F.row_number().over(W.partitionBy(*mine, "_file").orderBy(F.lit(1))))
    odd = odd.join(counts, [F.col(c).eqNullSafe(F.col("_" + c)) for c in (*mine, "_file")])
    odd = odd.withColumn("copies", F.col("whole") + (F.col("_from") + F.col("_number") <= F.col("drawn")).cast("long"))
    return even.unionByName(odd.select(*even.columns)).drop(*mine)


def copies(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, lean: float = LEAN, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row a document: doc_id, size, source_size, target, copies, taken (words the mix takes of it)."""
    prepare(docs.sparkSession)
    slim = settle(docs.select(*_sizes(docs, id_col, text_col, source_col)), "sizes")
    out = _dealt(slim, _drawn(slim, weights, most, lean, seed), ["doc_id", "source", "size"])
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, lean: float = LEAN, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: documents repeated as often as they are taken, columns as before."""
    prepare(docs.sparkSession)
    slim = settle(docs.select(*_sizes(docs, id_col, text_col, source_col)), "sizes")
    groups = _drawn(slim, weights, most, lean, seed).select("doc_id", "source", "size", "n", "whole", "drawn").where("whole + drawn > 0")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *(c.alias(n) for c, n in zip(_sizes(docs, id_col, text_col, source_col), ("id", "source", "size"), strict=True)))
    taken = _dealt(rows, groups, ["id", "source", "size"]).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
