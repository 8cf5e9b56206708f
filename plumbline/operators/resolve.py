"""Typed names against the names of a pack, and changed files against its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import fold


def resolve(typed: DataFrame, known: DataFrame, rule: str = "lower") -> DataFrame:
    """(typed, how, name, candidates): ``exact`` where the pack has that spelling,
    ``folded`` where one name folds together with it, ``ambiguous`` where several do
    (none is taken), else ``none``. ``typed``: (typed), ``known``: (name)."""
    k = known.select("name").distinct()
    t = typed.select("typed").distinct()
    exact = t.join(k.select(F.col("name").alias("typed"), F.lit(True).alias("same")), "typed", "left")
    if rule == "exact":
        return exact.select("typed", F.when(F.col("same"), "exact").otherwise("none").alias("how"), F.when(F.col("same"), F.col("typed")).alias("name"), F.lit(0).cast("long").alias("candidates"))
    hits = k.groupBy(fold(F.col("name"), rule).alias("f")).agg(F.count("*").alias("n"), F.min("name").alias("one"))
    j = exact.withColumn("f", fold(F.col("typed"), rule)).join(hits, "f", "left")
    how = F.when(F.col("same"), "exact").when(F.col("n") == 1, "folded").when(F.col("n") > 1, "ambiguous").otherwise("none")
    name = F.when(F.col("same"), F.col("typed")).when(F.col("n") == 1, F.col("one"))
    return j.select("typed", how.alias("how"), name.alias("name"), F.when(how == "ambiguous", F.col("n")).otherwise(0).cast("long").alias("candidates"))


def suggest(typed: DataFrame, known: DataFrame, most: int = 3, far: int = 3) -> DataFrame:
    """(typed, name, place): names that differ only in case first, then those at an
    edit distance of ``far`` or less that is under the typed length, nearest first.

    Pairs come from equal lower-case names or shared pieces: a name within ``far``
    edits of another keeps at least one of its far + 1 equal stretches whole, so
    only names that share one at nearly its place are compared."""
    k, t = known.select("name").distinct(), typed.select("typed").distinct()
    same = t.join(k, F.lower("typed") == F.lower("name")).where("typed <> name").select("typed", "name", F.lit(-1).alias("d"))
    size = F.length("typed")
    pieces = F.greatest(F.least(size, F.lit(far + 1)), F.lit(1))  # of a short name one letter at least stays
    cut_at = [F.floor(size * F.least(F.lit(i), pieces) / pieces).cast("int") for i in range(far + 2)]
    stretch = F.explode(F.array(*[F.struct(F.substring(F.col("typed"), a + 1, b - a).alias("s"), a.alias("at"), (b - a).alias("len")) for a, b in zip(cut_at, cut_at[1:])]))
    asked = t.select("typed", stretch.alias("x")).select("typed", "x.*").where("len > 0")
    lens = [r[0] for r in asked.select("len").distinct().collect()]  # no more than there are lengths of names
    at = F.explode(F.sequence(F.lit(0), F.length("name") - 1))
    grams = k.where("name <> ''").select("name", at.alias("p")).select("name", "p", F.explode(F.array(*[F.lit(int(n)) for n in lens or [1]])).alias("len"))
    grams = grams.where(F.col("p") + F.col("len") <= F.length("name")).select("name", "p", "len", F.substring(F.col("name"), F.col("p") + 1, F.col("len")).alias("s"))
    near = asked.join(grams, ["s", "len"]).where(F.abs(F.col("at") - F.col("p")) <= far).select("typed", "name").distinct()
    d = F.levenshtein("typed", "name", far)
    near = near.where((F.lower("typed") != F.lower("name"))).withColumn("d", d).where((F.col("d") >= 0) & (F.col("d") < size))
    w = Window.partitionBy("typed").orderBy("d", "name")
    return same.unionByName(near.select("typed", "name", "d")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("typed", "name", "place")


def normal_file(path):
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), r"^/+", "")


def nodes_in_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, id): nodes (id, file) of changed files (file): equal paths, or one the
    end of the other at a slash. Joined on the last segment, then compared."""
    n = nodes.where("file is not null").select("id", normal_file(F.col("file")).alias("own"))
    f = files.select("file", normal_file(F.col("file")).alias("want")).distinct()
    j = n.withColumn("base", F.substring_index("own", "/", -1)).join(f.withColumn("base", F.substring_index("want", "/", -1)), "base")
    a, b = F.col("own"), F.col("want")
    return j.where((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))).select("file", "id").distinct()


def strongest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the best grade (rank), then the fewest HTTP hops (http)."""
    best = F.max(F.struct("rank", (-F.col("http")).alias("h")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.rank").alias("rank"), (-F.col("b.h")).alias("http"))


def spliced(base: DataFrame, dirty: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts (with file) of a base without those of dirty files (file), and the newly
    read ones of these, marked ``provisional``."""
    kept = base.join(dirty.select("file").distinct(), "file", "left_anti").withColumn("provisional", F.lit(False))
    return kept.unionByName(fresh.join(dirty.select("file").distinct(), "file", "left_semi").withColumn("provisional", F.lit(True)), allowMissingColumns=True)


def plan_incremental(shards: DataFrame, now: DataFrame) -> DataFrame:
    """(file, action): ``reuse`` where the shard's key is the file's, ``reparse`` where
    it isn't or is missing, ``drop`` where the file is gone. Both: (file, key)."""
    j = shards.select("file", F.col("key").alias("was")).join(now.select("file", F.col("key").alias("is")), "file", "full_outer")
    return j.select("file", F.when(F.col("is").isNull(), "drop").when(F.col("was") == F.col("is"), "reuse").otherwise("reparse").alias("action"))
