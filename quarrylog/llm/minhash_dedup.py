"""Near-duplicate detection by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets are one member from then on.
Each tree branches members by a few minhash coordinates chosen per node: members
that agree on a chosen coordinate go to the same child, about ``1 / threshold``
coordinates per node. Small nodes are compared exhaustively. A large node links
its members to a leader and branches again, unless all its members are
connected, or all but a few, which are then compared with the whole node. What
is still together after a few levels is dense: such a node, if it fits a task
(a stated number of members and shingles), is compared exhaustively there,
leaving out pairs that are connected by then; a larger one branches on. What
meets is sieved by size and signature and confirmed on the full sets.

A tree parts a pair at the threshold the sooner or later the deeper it goes, so
the recall of the trees falls with the depth they reach (``tree_recall``). Where
nodes branched on below the dense levels, their members go through further
rounds of trees, each with signatures of its own, until the rounds together
reach ``target_recall`` at the depths they reached.

Members and full sets lie in tables bucketed by member, so a join on the member
moves only the other side. Of a pair one member, the carrier, is sent to the
other one; a leader, which many pairs share, is a carrier, and frequent carriers
are dealt over many tasks. The sieve compares the low byte of every signature
value, which can let more pairs through but never fewer.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing. A text of fewer words than a shingle has its whole
sequence as its only shingle. A null id never becomes a component's id unless
the component has no other. Repeated rows are equal sets. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from dataclasses import dataclass, replace
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrylog.llm.components import components
from quarrylog.llm.rolling import Hasher, mixed
from quarrylog.llm.word_pieces import give_back_memory, worker_memo
from quarrylog.operators.joins import spread_join
from quarrylog.session import cut_lineage, new_shared_path

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE = 1 << 20
#: Bytes of full sets that a bucket should hold, and the most buckets Spark allows.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


@dataclass(frozen=True)
class Config:
    words: int = 3
    percent: int = 85
    coordinates: int = 128
    trees: int = 12
    node_limit: int = 16
    dense_depth: int = 3
    dense_members: int = 4096
    dense_shingles: int = 4_000_000
    max_depth: int = 40
    signature_slack: float = 3.5
    target_recall: float = 0.999
    seed: int = 5


CONTRACT = Config()
#: The stage's own contract: five words, similarity of 0.8 or more.
STAGE = Config(words=5, percent=80)


def _hasher() -> Hasher:
    memo = worker_memo("hasher")
    if "one" not in memo:
        memo["one"] = Hasher()
    return memo["one"]


def word_hashes(body: bytes) -> np.ndarray:
    """One hash per word (bytes between ASCII white space, A-Z in lower case)."""
    hasher, out, at = _hasher(), [], 0
    body = body.lower()
    while at < len(body):
        to = at + PIECE
        while to < len(body) and not SPACE[body[to]]:  # cut between words
            to += 1
        data = np.frombuffer(body[at:to], np.uint8)
        edge = np.diff(np.concatenate(([True], SPACE[data], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append(mixed(hasher.spans(hasher.prefix(data), start, end) + (end - start).astype(np.uint64)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(body: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = word_hashes(body)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signature(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minhash values, one per factor pair, as 32-bit numbers."""
    least = np.full(factors.shape[1], np.iinfo(np.uint64).max)
    for at in range(0, len(items), 4096):
        h = items[at : at + 4096, None] * factors[0] + factors[1]
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _factors(config: Config) -> np.ndarray:
    rng = np.random.default_rng(config.seed)
    both = rng.integers(0, 1 << 63, (2, config.coordinates), np.uint64) * np.uint64(2)
    both[0] += np.uint64(1)
    return both


class _Tables:
    """Written tables bucketed by ``cid``; ``drop`` takes them out of the catalog once nothing joins them any more."""

    def __init__(self, spark, n_shingles: int):
        self.spark, self.names = spark, []
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * n_shingles // BUCKET_BYTES))
        self.buckets = min(wanted, MOST_BUCKETS)

    def write(self, df: DataFrame) -> DataFrame:
        name = f"quarrylog_by_cid_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "cid").write.format("parquet").bucketBy(self.buckets, "cid")
        writer.option("path", new_shared_path(self.spark, "by_cid")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def _sketch(sig: np.ndarray) -> np.ndarray:
    """The low byte of every signature value."""
    return sig.astype(np.int8)


def members(docs: DataFrame, config: Config) -> DataFrame:
    """``k1, k2, n_shingles, cid, sig``: the digest of every document's set, and its signature."""

    def run(batches):
        give_back_memory("hasher")
        factors = _factors(config)
        for batch in batches:
            n, cid, sig = [], [], []
            for body in batch.column(2):
                items = shingle_set(body.as_py(), config.words)
                n.append(len(items))
                cid.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                sig.append(signature(items, factors) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["k1", "k2", "n_shingles", "cid", "sig"])

    return docs.select("k1", "k2", "body").mapInArrow(run, "k1 long, k2 long, n_shingles long, cid binary, sig array<int>")


def full_sets(docs: DataFrame, config: Config) -> DataFrame:
    """``cid, items``: the shingle set of each given document."""

    def run(batches):
        give_back_memory("hasher")
        for batch in batches:
            items = [shingle_set(body.as_py(), config.words).view(np.int64) for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["cid", "items"])

    return docs.select("cid", "body").mapInArrow(run, "cid binary, items array<bigint>")


def _roots(config: Config) -> list[list[int]]:
    """Coordinates that each tree's root is branched by."""
    rng = random.Random(config.seed)
    extra = 100 / config.percent - 1
    return [rng.sample(range(config.coordinates), 1 + (rng.random() < extra)) for _ in range(config.trees)]


def _children(config: Config) -> Column:
    """Paths of the children that a member (``paths``, ``sig``) goes to; a node's path alone chooses the coordinates."""

    def of_node(path: Column) -> Column:
        at = lambda salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(config.coordinates)).cast("int")
        child = lambda c: F.xxhash64(path, c, F.get("sig", c))
        second = F.pmod(F.xxhash64(path, F.lit("second")), F.lit(1000)) < int(1000 * (100 / config.percent - 1))
        one, two = at("a"), at("b")
        return F.when(second & (one != two), F.array(child(one), child(two))).otherwise(F.array(child(one)))

    return F.explode(F.flatten(F.transform("paths", of_node)))


def _by_member(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per member of ``rows`` (``path``, ``cid``) with its ``paths``: what it is joined to comes once, however many nodes it is in."""
    return rows.groupBy("cid").agg(F.collect_list("path").alias("paths"), *more)


def least_agreement(config: Config) -> int:
    """Agreeing coordinates below which a pair is not looked at: the threshold's mean less ``signature_slack`` deviations."""
    share = config.percent / 100
    return int((share - config.signature_slack * (share * (1 - share) / config.coordinates) ** 0.5) * config.coordinates)


def tree_recall(config: Config, depth: int) -> float:
    """Chance that a round of trees holds a pair at the threshold together down to ``depth`` and the sieve lets it through.

    The trees share one signature, so the chance is averaged over the number of
    coordinates that a pair at the threshold agrees on.
    """
    share, extra, n = config.percent / 100, 100 / config.percent - 1, config.coordinates
    found = 0.0
    for k in range(least_agreement(config), n + 1):
        parted = 0.0
        for _ in range(depth):
            one = 1 - k / n + k / n * parted
            parted = (1 - extra) * one + extra * one * one
        found += comb(n, k) * share**k * (1 - share) ** (n - k) * (1 - parted**config.trees)
    return found


def _sketched(classes: DataFrame) -> DataFrame:
    """``classes`` with the ``sketch`` of every signature."""

    def run(batches):
        for batch in batches:
            sig = batch.column(1)
            values = pa.array(_sketch(sig.flatten().to_numpy()), pa.int8())
            offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * (len(values) // max(len(sig), 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], names=[*batch.schema.names, "sketch"])

    rows = classes.select("cid", "sig", *[c for c in classes.columns if c not in ("cid", "sig")])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sketch", T.ArrayType(T.ByteType()))]))


def _signed_anew(classes: DataFrame, sets: DataFrame, config: Config, tables: _Tables) -> DataFrame:
    """``cid, n, sig, sketch`` of ``classes`` with the signatures of ``config.seed``."""

    def run(batches):
        factors = _factors(config)
        for batch in batches:
            sig = [signature(items.values.to_numpy().view(np.uint64), factors) for items in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.list_(pa.int32()))], names=["cid", "sig"])

    wanted = sets.select("cid", "items").join(classes.select("cid"), "cid", "left_semi")
    signed = wanted.mapInArrow(run, "cid binary, sig array<int>").dropDuplicates(["cid"])
    return tables.write(_sketched(classes.select("cid", "n").join(signed, "cid")))


#: A carrier of over a 160th of the pairs is dealt over many tasks; there are fewer than 160 of those.
HOT_SHARE = 160


def _met(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (``carrier, target``) with the other columns of ``facts`` (by ``cid``) for both, as ``c_`` and ``t_``."""
    carried, stay = (
        facts.select(F.col("cid").alias(side), *[F.col(c).alias(f"{side[0]}_{c}") for c in facts.columns if c != "cid"])
        for side in ("carrier", "target")
    )
    total = pairs.agg(F.count("*")).scalar()
    frequent = pairs.groupBy("carrier").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_SHARE > total).select("carrier")
    frequent = F.broadcast(frequent)
    few = pairs.join(frequent, "carrier", "left_anti").join(carried, "carrier")
    many = spread_join(pairs.join(frequent, "carrier", "left_semi"), carried.join(frequent, "carrier", "left_semi"), ["carrier"], ["target"])
    return few.unionByName(many).join(stay, "target")


def _sieved(pairs: DataFrame, classes: DataFrame, config: Config) -> DataFrame:
    """Distinct pairs whose sizes and signatures allow the threshold; a pair that comes both ways is kept one way."""
    once = pairs.groupBy(*_ordered("carrier", "target")).agg(F.max("carrier").alias("carrier"))
    once = cut_lineage(once.select("carrier", F.when(F.col("carrier") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target")))
    rows = _met(once, classes.select("cid", "n", "sketch"))
    fits = 100 * F.least("c_n", "t_n") >= config.percent * F.greatest("c_n", "t_n")
    agree = F.aggregate(F.zip_with("c_sketch", "t_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return rows.where(fits).where(agree >= least_agreement(config)).select("carrier", "target")


def _confirmed(pairs: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    common = F.size(F.array_intersect("c_items", "t_items"))
    rows = _met(pairs, sets.select("cid", "items"))
    rows = rows.select(*_ordered("carrier", "target"), common.alias("common"), (F.size("c_items") + F.size("t_items") - common).alias("either"))
    return rows.where(100 * F.col("common") >= config.percent * F.col("either")).select("a", "b")


class _Node:
    """Members of one node in one task, with the connections known so far."""

    def __init__(self, rows: list[dict], config: Config):
        self.config = config
        self.cid = [r["cid"] for r in rows]
        self.comp = np.unique([r["comp"].hex() for r in rows], return_inverse=True)[1]
        self.sketch = np.stack([r["sketch"] for r in rows])
        self.n = np.array([len(r["items"]) for r in rows])
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        self.items = np.unique(np.concatenate([r["items"] for r in rows]), return_inverse=True)[1]
        self.mark = np.zeros(int(self.items.max()) + 1, bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Shingles that ``x`` shares with each of ``others``."""
        own = self.items[self.start[x] : self.start[x + 1]]
        self.mark[own] = True
        out = np.empty(len(others), np.int64)
        for at in range(0, len(others), 512):
            part = others[at : at + 512]
            ends = np.cumsum(self.n[part])
            flat = np.repeat(self.start[part] - (ends - self.n[part]), self.n[part]) + np.arange(ends[-1])
            out[at : at + 512] = np.add.reduceat(self.mark[self.items[flat]], ends - self.n[part], dtype=np.int64)
        self.mark[own] = False
        return out

    def links(self):
        """Links that connect what was apart, from the exact comparison of every pair still apart that the sieve lets through."""
        percent, least = self.config.percent, least_agreement(self.config)
        for x in range(len(self.cid) - 1):
            later = np.arange(x + 1, len(self.cid))
            apart = later[self.comp[later] != self.comp[x]]
            small, large = np.minimum(self.n[apart], self.n[x]), np.maximum(self.n[apart], self.n[x])
            apart = apart[100 * small >= percent * large]
            apart = apart[(self.sketch[apart] == self.sketch[x]).sum(1) >= least]
            if not len(apart):
                continue
            common = self.common(x, apart)
            for y in apart[100 * common >= percent * (self.n[apart] + self.n[x] - common)].tolist():
                if self.comp[y] != self.comp[x]:
                    self.comp[self.comp == self.comp[y]] = self.comp[x]
                    yield min(self.cid[x], self.cid[y]), max(self.cid[x], self.cid[y])


def _dense_links(rows: DataFrame, config: Config) -> DataFrame:
    """Links inside whole nodes (``path, cid, comp, sketch, items``); a task reads its nodes one after another."""

    def found(rows: list[dict]):
        pairs = list(_Node(rows, config).links())
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        give_back_memory("hasher")
        waiting: list[dict] = []
        for batch in batches:
            paths, cids, comps = (batch.column(i).to_pylist() for i in range(3))
            for i, path in enumerate(paths):
                if waiting and waiting[-1]["path"] != path:
                    yield found(waiting)
                    waiting = []
                sketch, items = (batch.column(c)[i].values.to_numpy().copy() for c in (3, 4))
                waiting.append({"path": path, "cid": cids[i], "comp": comps[i], "sketch": sketch, "items": items})
        if waiting:
            yield found(waiting)

    ordered = rows.select("path", "cid", "comp", "sketch", "items").repartition("path").sortWithinPartitions("path")
    return ordered.mapInArrow(run, "a binary, b binary")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(classes: DataFrame, texts: DataFrame, config: Config, tables: _Tables) -> DataFrame:
    """``(node, component)`` of the set classes (``cid, n, sig, sketch, k1, k2``) that confirmed links connect."""
    known, sets, late, depth = _round(classes, texts, config, tables)
    missed = 1 - tree_recall(config, depth)
    while late is not None and missed > 1 - config.target_recall:
        config = replace(config, seed=config.seed + 1)
        classes = _signed_anew(classes.join(late, "cid", "left_semi"), sets, config, tables)
        known, sets, late, depth = _round(classes, texts, config, tables, known, sets)
        missed *= 1 - tree_recall(config, depth)
    return known


def _round(classes: DataFrame, texts: DataFrame, config: Config, tables: _Tables, known: DataFrame | None = None, sets: DataFrame | None = None):
    """One round of trees: links known after it, full sets, members of nodes that branched on below the dense levels (or None), depth reached."""
    late = None
    roots = F.array(*[F.xxhash64(F.lit(t), F.lit(c), F.get("sig", F.lit(c))) for t, chosen in enumerate(_roots(config)) for c in chosen])
    active = classes.select("cid", F.explode(roots).alias("path"))
    for depth in range(1, config.max_depth + 1):
        nodes = active.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        live = active.join(nodes, "path")
        if known is not None:
            # What is left to compare: nodes of more than one component, with the members outside the largest one.
            live = live.join(known, F.col("cid") == F.col("node"), "left").select("path", "cid", "size", F.coalesce("component", "cid").alias("comp"))
            share = live.groupBy("path", "comp").agg(F.count("*").alias("m"))
            most = share.groupBy("path").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
            most = most.where("all > top.m").select("path", F.col("top.comp").alias("top"), (F.col("all") - F.col("top.m")).alias("others"))
            live = live.join(most, "path")
        else:
            live = live.select("path", "cid", "size", F.col("cid").alias("comp"), F.lit(None).cast("binary").alias("top"), (F.col("size") - 1).alias("others"))
        live = cut_lineage(live)
        last = depth == config.max_depth
        # Small nodes, and large ones with few members outside the largest component, are compared in full.
        full = live.where((F.col("size") <= config.node_limit) | (F.col("others") <= config.node_limit) | F.lit(last))
        outside = full.where("top is null or comp <> top").select("path", F.col("cid").alias("x"), F.col("comp").alias("x_comp"))
        across = outside.join(full.select("path", F.col("cid").alias("y"), F.col("comp").alias("y_comp")), "path").where("x <> y and x_comp <> y_comp")
        large = live.where((F.col("size") > config.node_limit) & (F.col("others") > config.node_limit) & ~F.lit(last))
        dense = None
        if depth >= config.dense_depth:
            sizes = _by_member(large).join(classes.select("cid", "n"), "cid").select("n", F.explode("paths").alias("path"))
            weight = sizes.groupBy("path").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
            fits = weight.where((F.col("m") <= config.dense_members) & (F.col("shingles") <= config.dense_shingles)).select("path")
            dense = large.select("path", "cid", "comp").join(fits, "path", "left_semi")
            large = cut_lineage(large.join(fits, "path", "left_anti"))
        # The member that meets most others over all large nodes is nearest to the middle of its group: it leads.
        middle = _by_member(large, F.sum("size").alias("met")).select("met", "cid", F.explode("paths").alias("path"))
        lead = middle.groupBy("path").agg(F.max(F.struct("met", "cid")).alias("leader"))
        star = large.join(lead.select("path", F.col("leader.cid").alias("leader")), "path")
        star = star.where("cid <> leader").select(F.col("leader").alias("carrier"), F.col("cid").alias("target"))
        pairs = across.select(F.col("x").alias("carrier"), F.col("y").alias("target")).unionByName(star)
        pairs = cut_lineage(_sieved(pairs, classes, config))
        large = large.select("path", "cid")
        if sets is None:
            needed = pairs.select(F.explode(F.array("carrier", "target")).alias("cid")).unionByName(large.select("cid")).distinct()  # later nodes are parts of these
            places = classes.join(needed, "cid", "left_semi").select("cid", "k1", "k2")
            sets = full_sets(texts.join(places.hint("shuffle_hash"), ["k1", "k2"]), config)
            sets = tables.write(sets)
        new = _confirmed(pairs, sets, config)
        if dense is not None:
            inside = _by_member(dense, F.min("comp").alias("comp")).join(classes.select("cid", "sketch"), "cid").join(sets, "cid")
            new = new.unionByName(_dense_links(inside.select(F.explode("paths").alias("path"), "cid", "comp", "sketch", "items"), config))
        new = cut_lineage(new)
        if known is None:
            known = components(new)
        elif not new.isEmpty():
            known = components(new.unionByName(known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if large.isEmpty():
            break
        if depth == config.dense_depth:
            late = cut_lineage(large.select("cid").distinct())  # later nodes are parts of these
        active = _by_member(large).join(classes.select("cid", "sig"), "cid").select("cid", _children(config).alias("path"))
    return known, sets, late, depth


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = CONTRACT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``text_key`` to tell rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(ids, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("body"))
    rows = cut_lineage(members(texts, config))
    # One member per distinct set; a copy meets its own task's copies first.
    best = F.min(F.struct("k1", "k2", "n_shingles", "sig")).alias("one")
    grouped = rows.where("n_shingles > 0").groupBy("cid").agg(best, F.min(F.when(F.col("k1") > -(1 << 63), F.col("k1"))).alias("least"))
    tables = _Tables(docs.sparkSession, rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    classes = tables.write(_sketched(grouped.select("cid", F.col("one.n_shingles").alias("n"), "one.sig", "one.k1", "one.k2", "least")))
    comps = linked(classes, texts, config, tables).withColumnRenamed("node", "cid")
    least = cut_lineage(classes.select("cid", "least"))
    tables.drop()
    placed = least.join(comps, "cid", "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "component").select("cid", "component_id")
    out = rows.select("k1", "k2", "n_shingles", "cid").join(placed, "cid", "left")
    own = F.when(F.col("k1") > -(1 << 63), F.col("k1"))
    out = out.select(own.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own).alias("component_id"), F.col("k2").alias("text_key"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = STAGE) -> DataFrame:
    """``docs`` with one row per component, that of the smallest id; rows without words stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = near_duplicates(docs, id_col, text_col, config).where("kept").select(F.col("doc_id").alias("keep"), "text_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("key") == F.col("text_key"))
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").select("row.*")
