"""History-based categorisation.

For each new description the ledger rows with a category whose lower-cased
description contains it, or is contained in it, vote for their (category,
subcategory); the most frequent pair wins, ties go to the alphabetically
first pair, no match gives ('', '').

The containment test is a theta join. It is blocked on n-grams, in a single equi-join on
(ledger key, blocking key):
  * a probe string of length >= 3 is keyed by its *rarest* trigram - the one in the fewest strings of
    the other side - and meets the strings that have it; `contains` verifies the candidates. A common
    beginning ("POS ", "PAYMENT") therefore costs nothing, and a probe with a trigram that no string
    has can't be contained anywhere and drops out;
  * a probe of length 1 or 2 is keyed by itself and meets strings having it
    among their distinct 1-/2-grams (equality is containment);
  * the empty probe has the key 'e', which every string carries once (linear:
    one row per description of the other side).
Both sides are first reduced to distinct lower-cased descriptions, and the
history to (description, category, subcategory, count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import stored_once


def _k(keys):
    return list(keys or [])


def _grams(s: Column, n: int) -> Column:
    """Distinct substrings of length n (the caller guarantees length(s) >= n)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n))))


def _probe_keys(s: Column) -> Column:
    """Candidate blocking keys of a string looked up as the shorter side: all its trigrams, or
    its one key when shorter."""
    n = F.length(s)
    return (F.when(n >= 3, F.transform(_grams(s, 3), lambda g: F.concat(F.lit("t"), g)))
            .when(n >= 1, F.array(F.concat(F.lit("s"), s)))
            .otherwise(F.array(F.lit("e"))))


def _index_keys(t: Column) -> Column:
    """All blocking keys under which a string can contain a shorter one."""
    n = F.length(t)
    tri = F.when(n >= 3, F.transform(_grams(t, 3), lambda g: F.concat(F.lit("t"), g))).otherwise(F.array())
    one = F.when(n >= 1, F.transform(_grams(t, 1), lambda g: F.concat(F.lit("s"), g))).otherwise(F.array())
    two = F.when(n >= 2, F.transform(_grams(t, 2), lambda g: F.concat(F.lit("s"), g))).otherwise(F.array())
    return F.concat(tri, one, two, F.array(F.lit("e")))


def _blocked(probe: DataFrame, index: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, _p, _i) with _i containing _p. The key of a probe is its rarest one in the index."""
    group = list(group)
    # the explode multiplies rows by ~3x the string length while its input is small in bytes, so
    # the strings are spread over the configured shuffle width first
    width = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = index.repartition(width, *group, "_i").withColumn("_k", F.explode(_index_keys(F.col("_i"))))
    asked = probe.repartition(width, *group, "_p").withColumn("_ks", _probe_keys(F.col("_p")))
    asked = asked.withColumn("_n", F.size("_ks")).withColumn("_k", F.explode("_ks")).drop("_ks")
    frequency = keyed.groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (asked.join(frequency, on=[*group, "_k"]).groupBy(*group, "_p", "_n")
              .agg(F.count(F.lit(1)).alias("_found"), F.min(F.struct("_df", "_k")).alias("_b"))
              .filter("_found = _n").select(*group, "_p", F.col("_b._k").alias("_k")))
    return rarest.join(keyed, on=[*group, "_k"]).filter(F.col("_i").contains(F.col("_p"))).drop("_k")


def containment_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """All (keys, x, y) with y containing x or x containing y, in one blocked join.

    Every string of both sides is probed once (as the possibly shorter side) and indexed
    once (under all its keys); a probe row of one side meets index rows of the other
    side only. Inputs hold distinct non-NULL strings.
    """
    keys = _k(keys)
    probe = (a.select(*keys, F.col(x).alias("_p"), F.lit(0).alias("_side"))
             .unionByName(b.select(*keys, F.col(y).alias("_p"), F.lit(1).alias("_side"))))
    index = (b.select(*keys, F.col(y).alias("_i"), F.lit(0).alias("_side"))
             .unionByName(a.select(*keys, F.col(x).alias("_i"), F.lit(1).alias("_side"))))
    m = _blocked(probe, index, [*keys, "_side"])
    return m.select(*keys, F.when(F.col("_side") == 0, F.col("_p")).otherwise(F.col("_i")).alias(x),
                    F.when(F.col("_side") == 0, F.col("_i")).otherwise(F.col("_p")).alias(y))


def predict_categories(new: DataFrame, history: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(keys, description, category, subcategory) for every distinct new description.

    The distinct descriptions and the aggregated history, which the plan reads more than once, are stored
    in the shared folder first, if there is one."""
    keys = _k(keys)
    hist = (history.filter(F.col("category") != "")
            .groupBy(*keys, F.lower("description").alias("hd"), "category", "subcategory")
            .agg(F.count(F.lit(1)).alias("n")))
    descs = new.select(*keys, "description").distinct().withColumn("nd", F.lower("description"))
    hist, descs = stored_once(hist, "vote-history"), stored_once(descs, "vote-descriptions")
    hd = hist.select(*keys, "hd").filter(F.col("hd").isNotNull()).distinct()
    nd = descs.select(*keys, "nd").filter(F.col("nd").isNotNull()).distinct()
    pairs = containment_pairs(nd, hd, keys, "nd", "hd").distinct()
    votes = pairs.join(hist, on=[*keys, "hd"]).groupBy(*keys, "nd", "category", "subcategory").agg(
        F.sum("n").alias("n"))
    votes = stored_once(votes, "votes")
    # top pair per description: the highest count by a hash aggregate, then the
    # alphabetically first pair among the (few) rows that reach it
    top = votes.groupBy(*keys, "nd").agg(F.max("n").alias("n"))
    best = votes.join(top, on=[*keys, "nd", "n"]).groupBy(*keys, "nd").agg(
        F.min(F.struct("category", "subcategory")).alias("_b"))
    out = descs.join(best, on=[*keys, "nd"], how="left")
    return out.select(*keys, "description",
                      F.coalesce(F.col("_b.category"), F.lit("")).alias("category"),
                      F.coalesce(F.col("_b.subcategory"), F.lit("")).alias("subcategory"))


def auto_categorize(staged: DataFrame, history: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows with an empty category take the predicted category and subcategory (both);
    other rows are unchanged. Predictions are computed only for those rows' descriptions."""
    keys = _k(keys)
    todo = staged.filter(F.col("category") == "").select(*keys, "description")
    pred = predict_categories(todo, history, keys).withColumnRenamed("category", "_pc").withColumnRenamed(
        "subcategory", "_ps")
    j = staged.join(pred, on=[*keys, "description"], how="left")
    empty = F.col("category") == ""
    return j.withColumn("subcategory", F.when(empty, F.coalesce("_ps", F.lit(""))).otherwise(F.col("subcategory"))) \
            .withColumn("category", F.when(empty, F.coalesce("_pc", F.lit(""))).otherwise(F.col("category"))) \
            .drop("_pc", "_ps")
