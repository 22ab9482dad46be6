"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of copies that each of its documents should have on
average: ``target share * total / documents of the source``.  Each document draws its
number of copies from a Poisson distribution with that mean by inverting the
distribution at a uniform number hashed from seed and document id, so a document's draw
depends on nothing but itself, the seed and the rate.  Copies are exploded and sorted
globally by a second hash: reading the result in order is a shuffled epoch.

Two passes: counts per source (map-side combined, so a source with a third of all rows is
one row per task), then the draw.  The rates are joined back by broadcast only if there
are few sources; otherwise by a shuffled join of which Spark splits skewed keys.

The cumulative distribution is computed once a source, not once a document.

Rates above ``CHUNK`` are drawn as sums of independent Poisson parts, so large rates
neither underflow nor lengthen the inversion.

Defined results: a null source is a source of its own; a null id hashes as the empty
text; repeated rows draw the same number; sources without a target get rate 0 under
explicit targets; a very long text is copied whole; input columns named like an output column
are replaced (``replicate``) or stay (``replicate_documents``); an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.names import sheltered
from catalith.plans.storage import checkpoint

BROADCAST_ROWS = 50_000
#: Largest rate drawn by one inversion, and the terms it may take (the tail beyond is below 1e-20).
CHUNK, TERMS = 16.0, 72


def uniform(seed: int, *parts: Column) -> Column:
    """A hash-seeded number in (0, 1), equal on every engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def cumulative(rate: Column) -> Column:
    """P(Poisson(rate) <= k) for k from 0, as far as it still grows or ``TERMS``."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    term = lambda a, i: F.struct((a["p"] * rate / i).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / i)).alias("c"))
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term, lambda a: a["c"])
    return F.array_distinct(whole)  # the sums never fall, so equal ones stand at the end


def _invert(u: Column, below: Column) -> Column:
    """Smallest k with u <= P(Poisson <= k)."""
    return F.least(F.lit(TERMS), F.size(F.filter(below, lambda c: c < u)))


def poisson(rate: Column, below: Column, below_chunk: Column, seed: int, key: Column) -> Column:
    """The hash-seeded Poisson count of a row (long); ``below`` is the table of the rate's rest after whole chunks."""
    whole = F.floor(rate / CHUNK).cast("int")
    extra = F.when(
        whole > 0,
        F.aggregate(F.sequence(F.lit(1), whole), F.lit(0), lambda a, i: a + _invert(uniform(seed, key, i), below_chunk)),
    ).otherwise(0)
    return (_invert(uniform(seed, key), below) + extra).cast("long")


def source_rates(df: DataFrame, source: str, targets: dict[str, float] | None, power: float, total: float | None) -> DataFrame:
    """Per source: ``_source``, documents and ``rate``.

    ``targets`` are explicit weights; without them a source weighs its share to ``power``.
    ``total`` copies are aimed at, by default as many as there are documents.
    """
    counts = df.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    if targets is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(power))
    else:
        pairs = [F.when(F.col("_source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in targets.items()]
        weight = F.coalesce(*pairs, F.lit(0.0))
    weighed = checkpoint(counts.withColumn("_w", weight))
    sums = weighed.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")).first()
    if not sums["w"]:
        return weighed.withColumn("rate", F.lit(0.0))
    aim = float(sums["n"] if total is None else total)
    return weighed.withColumn("rate", F.col("_w") / F.lit(float(sums["w"])) * F.lit(aim) / F.col("_n"))


def replicate(df: DataFrame, id_col: str = "doc_id", source: str = "source", targets: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Each row as often as drawn, with ``rate``, ``copy`` (from 0) and ``shuffle_key``, in shuffled order.

    Input columns of these names are replaced, and those with a name that begins with an underscore
    may be; :func:`replicate_documents` keeps all.  Rows of equal ``shuffle_key`` (equal ids) have no order.
    """
    # the distribution is tabled once a source; a document only looks its uniform number up
    tables = {"_below": cumulative(F.col("rate") - F.floor(F.col("rate") / CHUNK) * CHUNK), "_chunk": F.when(F.col("rate") >= CHUNK, cumulative(F.lit(CHUNK)))}
    rates = checkpoint(source_rates(df, source, targets, power, total).select("_source", "rate").withColumns(tables))
    few = rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    base = df.drop("rate", "copy", "shuffle_key")
    drawn = base.join(F.broadcast(rates) if few else rates, base[source].eqNullSafe(rates["_source"])).drop("_source")
    drawn = drawn.withColumn("_copies", poisson(F.col("rate"), F.col("_below"), F.col("_chunk"), seed, F.col(id_col))).drop("_below", "_chunk")
    copies = drawn.where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("shuffle_key", order).orderBy("shuffle_key")


def replicate_documents(df: DataFrame, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """As :func:`replicate`, with the columns of ``df`` and nothing else, whatever they are called."""
    return sheltered(df, lambda d, name: replicate(d, name(id_col), name(source), **options))
