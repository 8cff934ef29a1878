"""URL filtering by allow and block lists and by association rules mined from labelled urls, with DataFrame functions only.

1. List rules (host, path) decide the urls that they fit; the longest wins.
2. Labelled urls (by default those that a list rule decides) become transactions:
   their tokens and their label. The frequent sets are counted size by size
   (``EXACT``) or found by Spark's FP-growth (``DEFAULT``); sets with a
   label are rules ``tokens -> label``. Rules of little support or confidence go,
   and so do rules that a more general one of the same label and at least the
   same confidence makes superfluous.
3. Rules match by an inverted index: token -> rules. A url matches a rule if all
   of the rule's tokens hit it. The rule of highest confidence (then support,
   then length) decides; a url without a matching rule is allowed.

``EXACT`` mines every token of every labelled url. A set whose urls all have one label
is not extended: rules on larger sets would be superfluous beside its own. FP-growth
finds sets of any length, ``2 ** n`` for a url of ``n`` tokens, so under ``DEFAULT`` a
transaction holds its ``max_items`` most telling tokens only (by leverage, among the
``vocabulary`` most telling ones that have the support). Matching reads all tokens of
every url; a model of up to ``MODEL_ROWS`` rules is broadcast.

Defined cases: a null url, or one without ``://``, has an empty host, path and
token list: no rule fits and it is allowed. Repeated urls are judged once and
joined back, a frequent one spread over tasks. Without labelled urls no rule is
mined. Ties go to the rule of the alphabetically first tokens, then ``allow``. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.operators.joins import spread_join
from quarrylog.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
WORD = r"[\p{L}\p{N}]+"
ALLOW, BLOCK = "allow", "block"
#: Label items; no token starts with this mark.
MARK = "="


@dataclass(frozen=True)
class ListRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Config:
    min_support: float = 0.01
    min_percent: int = 80
    max_tokens: int = 3
    #: Tokens of a transaction and of all of them that FP-growth is given; without ``max_items`` all are mined, by levels.
    max_items: int | None = 8
    vocabulary: int | None = 1024


DEFAULT = Config()
EXACT = Config(max_items=None, vocabulary=None)
#: Rules that are broadcast at most.
MODEL_ROWS = 50_000


def parse(url: Column) -> dict[str, Column]:
    """``host`` (A-Z in lower case), ``path`` and ``tail`` (path, query and fragment)."""
    part = lambda k: F.regexp_extract(url, PARTS, k)
    return {"host": F.translate(part(1), UPPER, LOWER), "path": part(2), "tail": F.concat(part(2), part(3))}


def tokens(host: Column, tail: Column) -> Column:
    """Distinct words of host and tail, each marked with its part; digits count as one kind."""
    words = lambda text, mark: F.transform(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, "[0-9]+", "#"))
    )
    return F.array_distinct(F.concat(words(host, "h:"), words(F.translate(tail, UPPER, LOWER), "p:")))


def list_rule(host: Column, path: Column, rules: tuple[ListRule, ...]) -> Column:
    """The longest fitting rule as a struct of ``name`` and ``verdict``, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def transactions(labelled: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, int]:
    """``items`` of every labelled url (``tokens, verdict``), and the least number of urls that a set must hold."""
    labelled = cut_lineage(labelled.select("tokens", "verdict"))
    total, blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == BLOCK)).first()
    least = ceil(config.min_support * total)
    seen = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == BLOCK).alias("b"))
    seen = seen.groupBy("token").agg(F.count("*").alias("n"), F.count_if("b").alias("m")).where(F.col("n") >= least)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    leverage = F.abs(wide("m") * total - wide("n") * blocked)
    telling = [r.token for r in seen.select("token", leverage.alias("leverage")).orderBy(F.desc("leverage"), "token").limit(config.vocabulary).collect()]
    known = F.array(*map(F.lit, telling)) if telling else F.array().cast("array<string>")
    ranks = F.filter(F.transform("tokens", lambda t: F.array_position(known, t)), lambda p: p > 0)
    kept = F.transform(F.slice(F.array_sort(ranks), 1, config.max_items), lambda p: F.get(known, p.cast("int") - 1))
    return labelled.select(F.concat(kept, F.array(F.concat(F.lit(MARK), "verdict"))).alias("items")), least


def frequent_by_levels(labelled: DataFrame, config: Config = EXACT) -> tuple[DataFrame, int]:
    """``tokens, n, m`` (urls, and blocked ones) of the frequent sets of up to ``max_tokens``, all tokens of every url counted; and the least ``n``.

    A frequent set is extended by the later tokens of the urls that hold it,
    unless they all have one label.
    """
    same = labelled.select(F.array_sort("tokens").alias("items"), (F.col("verdict") == BLOCK).cast("long").alias("b"))
    # Urls of one site have few token sets.
    same = cut_lineage(same.groupBy("items").agg(F.count("*").alias("n"), F.sum("b").alias("m")))
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = ceil(config.min_support * total)
    held, levels = same.withColumn("tokens", F.array().cast("array<string>")), []
    for k in range(config.max_tokens):
        later = F.filter("items", lambda t: F.lit(True) if k == 0 else t > F.element_at("tokens", -1))
        held = held.select("items", "n", "m", "tokens", F.explode(later).alias("next")).select("items", "n", "m", F.concat("tokens", F.array("next")).alias("tokens"))
        counted = held.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        levels.append(cut_lineage(counted.where(F.col("n") >= least)))
        held = held.join(levels[-1].where("m > 0 and m < n").select("tokens"), "tokens", "left_semi")
    return reduce(DataFrame.unionByName, levels), least


def _counted(labelled: DataFrame, config: Config) -> DataFrame:
    """``tokens, verdict, support, n`` of every frequent set with a label."""
    if config.max_items is None:
        sets, least = frequent_by_levels(labelled, config)
        by_label = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), x.alias("support")) for v, x in ((BLOCK, F.col("m")), (ALLOW, F.col("n") - F.col("m")))]))
        return sets.select("tokens", "n", by_label.alias("c")).select("tokens", "c.verdict", "c.support", "n").where((F.col("support") > 0) & (F.col("support") >= least))
    items, _ = transactions(labelled, config)
    sets = cut_lineage(FPGrowth(itemsCol="items", minSupport=config.min_support).fit(items).freqItemsets)
    label = F.filter("items", lambda i: F.startswith(i, F.lit(MARK)))
    plain = F.array_sort(F.filter("items", lambda i: ~F.startswith(i, F.lit(MARK))))
    sets = sets.select(plain.alias("tokens"), label.alias("label"), "freq").where((F.size("tokens") > 0) & (F.size("tokens") <= config.max_tokens))
    whole = sets.where(F.size("label") == 0).select("tokens", F.col("freq").alias("n"))
    return sets.where(F.size("label") == 1).select("tokens", F.substring(F.col("label")[0], len(MARK) + 1, 99).alias("verdict"), F.col("freq").alias("support")).join(whole, "tokens")


def mine(labelled: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rules ``tokens, verdict, n_tokens, support, confidence`` (in millionths) from labelled urls (``tokens, verdict``)."""
    sure = _counted(labelled, config).where(100 * F.col("support") >= config.min_percent * F.col("n"))
    sure = cut_lineage(sure.select("tokens", "verdict", F.size("tokens").alias("n_tokens"), "support", F.expr("1000000 * support div n").alias("confidence")))
    return cut_lineage(sure.join(_superfluous(sure, config), ["tokens", "verdict"], "left_anti"))


def _superfluous(rules: DataFrame, config: Config) -> DataFrame:
    """Rules for which one with fewer of their tokens, the same verdict and at least their confidence exists."""
    parts = F.array(F.array().cast("array<string>"))
    for k in range(config.max_tokens):  # all subsets, token by token
        token = F.array(F.get("tokens", F.lit(k)))  # not a second lambda argument: that would be the position in parts
        parts = F.when(F.size("tokens") > k, F.concat(parts, F.transform(parts, lambda p: F.concat(p, token)))).otherwise(parts)  # noqa: B023
    general = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("reached"))
    parted = rules.select("tokens", "verdict", "confidence", F.explode(parts).alias("part")).where("size(part) > 0 and size(part) < size(tokens)")
    beaten = parted.join(general, "part").where("verdict = same and reached >= confidence")
    return beaten.select("tokens", "verdict").distinct()


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, learnt``: the verdict of the best rule that fits each url (``url, tokens``; distinct urls)."""
    index = rules.select(F.explode("tokens").alias("token"), F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.col("n_tokens")).alias("n"), F.array_join("tokens", " ").alias("t"), "verdict").alias("rule"), "n_tokens")
    hits = urls.select("url", F.explode("tokens").alias("token")).join(F.broadcast(index) if rules.count() <= MODEL_ROWS else index, "token")
    full = hits.groupBy("url", "rule").agg(F.count("*").alias("hits"), F.first("n_tokens").alias("n_tokens")).where("hits = n_tokens")
    return full.groupBy("url").agg(F.min("rule").alias("best")).select("url", F.col("best.verdict").alias("learnt"))


def judge(pages: DataFrame, rules: tuple[ListRule, ...], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and ``learnt``, the mined rules' verdict if one matches.

    ``labelled`` (``url, verdict``) trains the rules; without it the pages that a list rule decides do.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    urls = rows.groupBy("url").agg(F.count("*").alias("n"))
    urls = urls.select("url", "n", *[c.alias(k) for k, c in parse(F.col("url")).items()])
    urls = urls.select("url", "n", "host", "path", tokens(F.col("host"), F.col("tail")).alias("tokens"), list_rule(F.col("host"), F.col("path"), rules).alias("listed"))
    urls = cut_lineage(urls)
    if labelled is None:
        decided = urls.where("listed is not null")
        training = decided.select("tokens", F.col("listed.verdict").alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    else:
        parts = labelled.select("verdict", *[c.alias(k) for k, c in parse(F.coalesce("url", F.lit(""))).items()])
        training = parts.select(tokens(F.col("host"), F.col("tail")).alias("tokens"), "verdict")
    learnt = matched(urls.where("listed is null"), mine(training, config))
    judged = urls.select("url", "n", "host", "path", "listed").join(learnt, "url", "left")
    out = spread_join(rows, cut_lineage(judged), ["url"], ["page_id"], n="n")
    verdict = F.coalesce("listed.verdict", "learnt", F.lit(ALLOW))
    return out.select("page_id", "host", "path", F.col("listed.name").alias("rule"), verdict.alias("verdict"), "learnt")
