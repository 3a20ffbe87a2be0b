"""The category vote (C3, D12) from a stored index that changes with the ledger.

Two tables of signed rows, which readers add up:
  votes  (keys, hd, category, subcategory, n)  how often history gives a lower-cased description a category
  grams  (keys, kind, k, hd, c)                where to look a description up, as long as it has a vote

Rows are only appended (a batch's own, a delete's with a minus sign), so a batch costs its own rows; history is
never exploded again. A new text nd meets a history text hd
  * that contains nd: under the rarest of nd's trigrams (kind `i`: hd's trigrams, 1- and 2-grams),
  * that nd contains: under hd's one key (kind `r`): the 8-gram of least hash, a shorter text itself; nd asks for all
    its 8-grams and all its shorter pieces.
`contains` verifies the candidates. A key is a pure function of hd, so a retraction meets what it retracts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.categorize import _grams, _index_keys, _probe_keys

BUCKETS = 64
PIECE = 8  # a longer text is looked up by one piece of this length
INSIDE, WHOLE = "i", "r"


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int").alias("bucket")


def vote_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed votes of signed ledger rows; rows without a category don't vote, and what cancels out is left out."""
    keys = list(keys)
    n = (changes.filter(F.col("category") != "").groupBy(*keys, F.lower("description").alias("hd"), "category", "subcategory")
         .agg(F.sum("sign").alias("n")).filter("n != 0"))
    return n.withColumn("bucket", _bucket(*keys, "hd"))


def votes_now(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return votes.groupBy(*list(keys), "hd", "category", "subcategory").agg(F.sum("n").alias("n")).filter("n > 0")


def _look_up_key(hd: Column) -> Column:
    n = F.length(hd)
    pieces = F.transform(_grams(hd, PIECE), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    return F.when(n > PIECE, F.array_min(pieces)["g"]).otherwise(hd)


def _asked_keys(nd: Column) -> Column:
    """All keys under which a text contained in `nd` may be filed."""
    n = F.length(nd)
    each = [F.when(n >= k, _grams(nd, k)).otherwise(F.array().cast("array<string>")) for k in range(1, PIECE + 1)]
    return F.concat(*each, F.array(F.lit("")))


def gram_changes(changes: DataFrame, before: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Index rows of the texts that gain their first vote (c = 1) or lose their last (c = -1).

    `changes` are signed rows of the votes table; only the texts in them are compared with `before`."""
    keys = list(keys)
    text = [*keys, "hd"]
    delta = changes.groupBy(*text, "category", "subcategory").agg(F.sum(F.col("n") * F.col("sign")).alias("d")).filter("d != 0 and hd is not null")
    both = delta.withColumn("n", F.lit(0).cast("long"))
    if before is not None:
        asked = delta.select(*[F.col(c).alias(f"_{c}") for c in text]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in text]
        old = votes_now(before, keys).join(asked, same, "left_semi")
        both = both.unionByName(old.withColumn("d", F.lit(0).cast("long")).select(*both.columns))
    pair = both.groupBy(*text, "category", "subcategory").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    turn = pair.groupBy(*text).agg(F.max((F.col("n") > 0).cast("int")).alias("was"), F.max((F.col("n") + F.col("d") > 0).cast("int")).alias("is"))
    moved = turn.filter(F.col("was") != F.col("is")).withColumn("c", (F.col("is") - F.col("was")).cast("long"))
    entry = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"))
    entries = F.concat(F.transform(_index_keys(F.col("hd")), lambda k: entry(INSIDE, k)), F.array(entry(WHOLE, _look_up_key(F.col("hd")))))
    rows = moved.select(*text, "c", F.explode(entries).alias("e")).select(*keys, "e.kind", "e.k", "hd", "c")
    return rows.withColumn("bucket", _bucket(*keys, "kind", "k"))


def predict(new: DataFrame, votes: DataFrame, grams: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(keys, description, category, subcategory) for every distinct new description, as
    `categorize.predict_categories` gives it, from the stored votes and index."""
    keys = list(keys or [])
    descs = new.select(*keys, "description").distinct().withColumn("nd", F.lower("description"))
    nd = descs.select(*keys, "nd").filter("nd is not null").distinct()
    # the index rows under the keys that the batch asks for; signed rows of a text add up to 1 or 0
    inside = nd.select(*keys, "nd", F.size(_probe_keys(F.col("nd"))).alias("need"), F.explode(_probe_keys(F.col("nd"))).alias("k"))
    whole = nd.select(*keys, "nd", F.explode(F.array_distinct(_asked_keys(F.col("nd")))).alias("k"))
    on = [*keys, "k"]
    live = lambda kind, asked: (grams.filter(F.col("kind") == kind).join(asked.select(*on).distinct(), on, "left_semi")
                                .groupBy(*on, "hd").agg(F.sum("c").alias("c")).filter("c > 0").drop("c"))
    files = live(INSIDE, inside)
    often = files.groupBy(*on).agg(F.count(F.lit(1)).alias("df"))
    rarest = (inside.join(often, on).groupBy(*keys, "nd", "need").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "k")).alias("b"))
              .filter("found = need").select(*keys, "nd", F.col("b.k").alias("k")))
    longer = rarest.join(files, on).filter(F.col("hd").contains(F.col("nd")))
    shorter = whole.join(live(WHOLE, whole), on).filter(F.col("nd").contains(F.col("hd")))
    pairs = longer.select(*keys, "nd", "hd").unionByName(shorter.select(*keys, "nd", "hd")).distinct()
    n = pairs.join(votes_now(votes, keys), [*keys, "hd"]).groupBy(*keys, "nd", "category", "subcategory").agg(F.sum("n").alias("n"))
    top = n.groupBy(*keys, "nd").agg(F.max("n").alias("n"))
    best = n.join(top, [*keys, "nd", "n"]).groupBy(*keys, "nd").agg(F.min(F.struct("category", "subcategory")).alias("b"))
    out = descs.join(best, [*keys, "nd"], "left")
    return out.select(*keys, "description", F.coalesce("b.category", F.lit("")).alias("category"), F.coalesce("b.subcategory", F.lit("")).alias("subcategory"))
