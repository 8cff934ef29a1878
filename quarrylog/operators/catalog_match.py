"""Matching queries to tables, databases and to each other by the tables they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.functions.scores import table_overlap
from quarrylog.operators.compute import once
from quarrylog.operators.joins import first_per_group, spread_join
from quarrylog.session import cut_lineage

SEP = ","


def table_index(log: DataFrame, key: str, tables: Column) -> DataFrame:
    """Inverted index, one row per (table, query)."""
    return log.select(F.explode(F.array_distinct(tables)).alias("table_name"), key)


def known_tables(log: DataFrame, key: str, tables: Column, catalog: DataFrame) -> DataFrame:
    """Per query the sorted tables that the catalog holds."""
    used = log.select(key, F.explode(tables).alias("table_name"))
    kept = used.join(catalog.select("table_name").distinct(), "table_name", "left_semi")
    return kept.groupBy(key).agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def owning_database(
    log: DataFrame, key: str, members: Column, catalog: DataFrame, db: str, member: str, last_wins: bool = True
) -> DataFrame:
    """The database that holds every member a query uses; null where none does.

    Decided between distinct member sets and distinct database contents. A set
    meets only the contents that hold its rarest member, and is then checked
    whole, so common members make no pairs.
    """
    named = log.select(key, F.array_sort(F.array_distinct(members)).alias("members"))
    sets = cut_lineage(named.withColumn("set_key", F.array_join("members", SEP)))
    distinct = sets.where(F.size("members") > 0).groupBy("set_key").agg(
        F.first("members").alias("members"), F.count("*").alias("n_queries")
    )

    pick = F.max if last_wins else F.min
    held = catalog.groupBy(db).agg(F.array_sort(F.collect_set(member)).alias("held"))
    contents = cut_lineage(held.groupBy("held").agg(pick(db).alias("owner")))
    by_member = contents.select("held", "owner", F.explode("held").alias(member))
    rarity = by_member.groupBy(member).agg(F.count("*").alias("n"))

    needed = distinct.select("set_key", "members", F.explode("members").alias(member)).join(rarity, member, "left")
    # An unknown member counts as rarest, and no content holds it.
    rarest = needed.groupBy("set_key").agg(
        F.first("members").alias("members"), F.min_by(member, F.struct(F.coalesce("n", F.lit(0)), member)).alias(member)
    )
    met = rarest.join(by_member, member).where(F.size(F.array_except("members", "held")) == 0)
    owners = met.groupBy("set_key").agg(pick("owner").alias("owner")).join(distinct.select("set_key", "n_queries"), "set_key")
    return spread_join(sets.select(key, "set_key"), owners, ["set_key"], [key], "left", n="n_queries").select(key, "owner")


def shared_names(catalog: DataFrame, db: str, name: str, body: str) -> DataFrame:
    """Pairs of databases with a table of the same name, and with the same body too.

    Pairs are counted from group sizes, never formed.
    """
    per_body = catalog.groupBy(name, body).agg(F.count_distinct(db).alias("n"))
    per_name = per_body.groupBy(name).agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same_body")
    )
    return per_name.agg(
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("same_name_pairs"),
        F.coalesce(F.sum("same_body"), F.lit(0)).alias("same_schema_pairs"),
    )


def _ranked_sets(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """``set_key, tables, n, ids`` of the distinct table sets: rarest table first, and the first ``keep`` queries."""
    firsts = first_per_group(rows, ["set_key"], [key], keep, "pos")
    sets = firsts.groupBy("set_key").agg(F.first("tables").alias("tables"), F.array_sort(F.collect_list(key)).alias("ids"))
    sets = cut_lineage(sets)
    members = sets.select("set_key", F.explode("tables").alias("table_name"))
    rarity = members.groupBy("table_name").agg(F.count("*").alias("df"))
    ordered = spread_join(members, rarity, ["table_name"], ["set_key"], n="df").groupBy("set_key")
    ordered = ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "table_name"))), lambda t: t["table_name"]).alias("tables"))
    return cut_lineage(ordered.join(sets.select("set_key", "ids"), "set_key").select("set_key", "tables", F.size("tables").alias("n"), "ids"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each probe's candidates ``(probe, id, score)``, each counted once."""
    once_each = scored.groupBy("probe", "id").agg(F.first("score").alias("score"))
    return first_per_group(once_each, ["probe"], [F.desc("score"), "id"], k, "pos")


def overlapping_queries(log: DataFrame, key: str, tables: Column, k: int = 5) -> DataFrame:
    """For each query the ``k`` others with the best table overlap (V4), ties by key.

    The score depends on the two table sets alone, so it is worked out between
    distinct sets, in one plan for sets of any size.

    1. A probe meets the first ``k + 1`` queries of each (table, size) list of its
       tables, and of each size. A query that shares one table with it, or none,
       is beaten by those. The ``k + 1``-th best of them bounds the answer from below.
    2. What else can reach that bound shares as many tables as the bound says, two
       at least. Two sets that share ``o`` tables share one among the rarest tables
       of both, all but ``o - 1`` each; so only the postings of a probe's rarest
       tables are read, where the sizes allow the bound.
    """
    named = once(log, tables=F.array_sort(F.array_distinct(tables))).select(key, "tables").where(F.size("tables") > 0)
    # Read three times below; the set key is far smaller than the SQL it comes from.
    rows = cut_lineage(named.withColumn("set_key", F.array_join("tables", SEP)))
    sets = _ranked_sets(rows, key, k + 1)
    probes = sets.select(F.col("set_key").alias("probe"), F.col("tables").alias("probe_tables"), F.col("n").alias("probe_n"))
    score = table_overlap(F.col("probe_tables"), F.col("tables")).alias("score")
    # Every set is listed under no table, too.
    lists = sets.select(F.explode(F.concat("tables", F.array(F.lit("")))).alias("table_name"), "n", "tables", F.explode("ids").alias("id"))
    heads = first_per_group(lists, ["table_name", "n"], ["id"], k + 1, "pos").drop("pos")
    asked = probes.select("probe", "probe_tables", F.explode(F.concat("probe_tables", F.array(F.lit("")))).alias("table_name"))
    asking = asked.groupBy("table_name").agg(F.count("*").alias("n_probes"))
    total = asked.groupBy().count().scalar()
    met = spread_join(asked, heads.join(asking, "table_name"), ["table_name"], ["probe"], n="n_probes", total=total)
    own = sets.select(F.col("set_key").alias("probe"), F.explode("ids").alias("id"), F.col("n").cast("double").alias("score"))
    first = cut_lineage(_best(met.select("probe", "id", score).unionByName(own), k + 1).drop("pos"))

    bounds = first.groupBy("probe").agg(F.min("score").alias("least"), F.count("*").alias("found")).where(F.col("found") > k)
    shared = F.greatest(F.lit(2), F.ceil("least")).cast("int")
    deep = probes.join(bounds, "probe").withColumn("shared", shared).where("shared <= probe_n")
    deep = deep.withColumn("table_name", F.explode(F.slice("probe_tables", F.lit(1), F.col("probe_n") - F.col("shared") + 1)))
    posts = sets.select("set_key", "tables", "n", "ids", F.posexplode("tables").alias("place", "table_name"))
    wanted = deep.groupBy("table_name").agg(F.count("*").alias("n_probes"))
    pairs = spread_join(deep, posts.join(wanted, "table_name"), ["table_name"], ["probe"], n="n_probes", total=deep.groupBy().count().scalar())
    reach = F.least("probe_n", "n") - F.abs(F.col("probe_n") - F.col("n")) / F.col("probe_n")
    pairs = pairs.where((F.col("place") <= F.col("n") - F.col("shared")) & (reach >= F.col("least")) & (F.col("probe") != F.col("set_key")))
    more = pairs.select("probe", "ids", "least", score).where("score >= least").select("probe", F.explode("ids").alias("id"), "score")

    best = _best(first.unionByName(more.select(first.columns)), k + 1)
    lists = best.groupBy(F.col("probe").alias("set_key")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "score"))).alias("best")
    )
    sizes = rows.groupBy("set_key").agg(F.count("*").alias("n_queries"))
    joined = spread_join(rows.select(key, "set_key"), lists.join(sizes, "set_key"), ["set_key"], [key], n="n_queries")
    others = F.slice(F.filter("best", lambda c: c["id"] != F.col(key)), 1, k)
    return joined.select(key, F.posexplode(others).alias("rank", "c")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("c.id").alias(f"other_{key}"), F.col("c.score").alias("score")
    )


def examples_without_self(log: DataFrame, key: str, group: str, order: list, m: int) -> DataFrame:
    """For each query the first ``m`` log entries of its group other than itself."""
    heads = first_per_group(log.select(group, F.col(key).alias("example"), *order), [group], [*order, "example"], m + 1, "pos")
    lists = heads.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "example"))).alias("heads"))
    joined = spread_join(log.select(key, group), lists, [group], [key])
    kept = F.slice(F.filter("heads", lambda c: c["example"] != F.col(key)), 1, m)
    return joined.select(key, F.posexplode(kept).alias("rank", "c")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("c.example").alias("example")
    )
