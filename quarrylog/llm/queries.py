"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.llm import bpe, chat_format, exact_dedup, merkle_manifest, minhash_dedup, mixing, phrase_mining, quality_rules, suffix_dedup, token_counts, token_store, url_rules, weak_labels
from quarrylog.session import new_shared_path

#: Folder of the public tokenizer files, or where the installed package keeps them.
TOKENIZERS = "QUARRYLOG_TOKENIZERS"
TOKEN_LIMIT = 2048


@cache
def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if folder := os.environ.get(TOKENIZERS):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("cleaned")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path())
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    done = chat_format.format_conversations(turns.union(tricky))
    back = done.select("conv_id", "valid", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(spoken).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars", "valid",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, tokenizer_path())
    return token_store.read_digests(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    return groups.withColumnRenamed("digest", "text_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    words = quality_rules.words_of(F.col("text"))
    facts = docs.select("doc_id", "source", "lang", words.alias("words")).select("doc_id", "source", "lang", F.size("words").alias("n_tokens"), mixing.topic_of(F.col("words")).alias("topic"))
    mixed = mixing.mix(facts, "doc_id", "n_tokens")
    return mixed.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *mixing.DIMENSIONS, F.round("probability", 6).alias("probability"), "kept", F.round("weight", 6).alias("weight"), "copies")


#: The list rules of the query: verdict, host, path.
URL_RULES = tuple(url_rules.ListRule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, config=url_rules.EXACT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, and what its proofs say of rows whose texts were lower-cased."""
    lowered = F.translate("text", url_rules.UPPER, url_rules.LOWER)
    fields = [lowered if f == "text" else F.col(f) for f in merkle_manifest.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle_manifest.leaf(fields))
    done = merkle_manifest.manifest(documents(spark, sf_dir), carry={"tampered": tampered})
    root = merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = done.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("steps")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_rules, op3_bpe_codec, op4_minhash_dedup, op5_quality_classifier,
        op6_chat_format, op7_token_counts, op8_token_store, op9_exact_dedup, op10_source_mixing,
        op11_url_rules, op12_merkle_manifest, op13_phrase_mining,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _chars_of(text: str, characters: str) -> str:
    """SQL for how many characters of ``text`` are among ``characters``."""
    return f"(len({text}) - len(translate({text}, '{characters}', '')))"


def _line_ok(line: str, words: str, rules: quality_rules.Rules = quality_rules.DEFAULT) -> str:
    """The line rules as SQL."""
    capitals = f"(len({line}) - len(regexp_replace({line}, '\\p{{Lu}}', '', 'g')))"
    letters = f"(len({line}) - len(regexp_replace({line}, '\\p{{L}}', '', 'g')))"
    ends = f"regexp_matches({line}, '[.!?:;…。\"''”’)\\]][\\x20\\x09-\\x0D]*$')"
    return (
        f"({_chars_of(line, '#*$%&|<>')} <= len({line}) * {rules.max_line_symbol_share}"
        f" AND NOT ({words} >= {rules.min_open_line_words} AND {capitals} > {letters} * {rules.max_line_shout_share})"
        f" AND ({ends} OR {words} >= {rules.min_open_line_words})"
        f" AND {_chars_of(line, '|»›•')} < {rules.max_menu_separators}"
        f" AND NOT regexp_matches({line}, '{rules.navigation}') AND NOT regexp_matches({line}, '{rules.boilerplate}'))"
    )


OP2_SQL = rf"""WITH base AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (
  SELECT row_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (NOT ok) AS n_failed_lines, coalesce(sum(n) FILTER (ok), 0) AS n_kept_words
  FROM (SELECT *, {_line_ok('line', 'n')} AS ok FROM lines) GROUP BY row_no),
windows AS (
  SELECT row_no, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT row_no, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words
  FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS next FROM twice) GROUP BY row_no),
figures AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: len(w))), 0) AS word_chars,
    {_chars_of('text', '#*$%&|<>')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_kept_words, 0) AS n_kept_words
  FROM base LEFT JOIN judged USING (row_no) LEFT JOIN repeats USING (row_no)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(n_kept_words AS BIGINT) AS n_kept_words,
  NOT base_failed AND 100 * n_kept_words >= {quality_rules.DEFAULT.min_kept_percent} * n_words AS kept
FROM failed"""


def _op6_sql(template: chat_format.Template = chat_format.DEFAULT) -> str:
    def escaped(text: str) -> str:
        text = f"replace({text}, '\\', '\\\\')"
        for c in template.controls():
            text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
        return text

    marks = " ".join(f"WHEN '{r}' THEN {len(template.opens[r]) + len(template.closes[r])}" for r in template.opens)
    other = f"{len(template.other_open) + len(template.other_name_end)} + len({escaped('role')})"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS spoken,
    coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss,
    sum(CASE role {marks} ELSE {other} END + len({escaped('text')}) + {len(template.end)}) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' {order}) AS roles
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM joined"""


OP9_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _op10_sql(rounds: int = mixing.ROUNDS, power: float = 0.7, seed: int = 17) -> str:
    """Raking unrolled: one step per round and dimension."""
    steps, last = [], "cells"
    for r in range(rounds):
        for d in mixing.DIMENSIONS:
            name = f"r{r}_{d}"
            now = f"sum(fitted) OVER (PARTITION BY c.{d})"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CASE WHEN {now} > 0 THEN fitted * (goal * (SELECT sum(tokens) FROM cells) / {now}) ELSE 0 END AS fitted"
                f" FROM {last} c JOIN goal_{d} g ON c.{d} = g.{d})"
            )
            last = name
    goals = [
        f"goal_{d} AS MATERIALIZED (SELECT {d}, raised / sum(raised) OVER () AS goal FROM (SELECT {d}, pow(sum(tokens), {power}) AS raised FROM cells GROUP BY {d}))"
        for d in mixing.DIMENSIONS
    ]
    return f"""WITH base AS (
  SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, {_WORDS} AS words FROM documents),
longest AS (SELECT *, list_max(list_transform(words, lambda w: len(w))) AS longest FROM base),
facts AS MATERIALIZED (
  SELECT doc_id, len(words) AS n_tokens, source, lang,
    coalesce('t' || CAST(unicode(list_max(list_filter(words, lambda w: len(w) = longest))) % {mixing.TOPICS} AS VARCHAR), '{mixing.NONE}') AS topic FROM longest),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS fitted FROM facts GROUP BY ALL),
{', '.join(goals)}, {', '.join(steps)},
ratios AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN fitted / tokens END AS ratio FROM {last}),
sums AS (SELECT sum(tokens) AS tokens, sum(fitted) AS fitted FROM ratios),
-- Cells of the greatest ratios are kept whole: the scale for the others once the first cells are, and whether the next cell stays below 1.
filled AS (
  SELECT (:share * (SELECT tokens FROM sums) - full_tokens) / open_fitted AS lift, ratio AS next, full_tokens
  FROM (SELECT ratio, sum(fitted) OVER (ORDER BY ratio DESC) AS upto,
      coalesce(sum(tokens) OVER (ORDER BY ratio DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS full_tokens,
      sum(fitted) OVER (ORDER BY ratio DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_fitted
    FROM ratios WHERE ratio > 0)),
scale AS (SELECT coalesce((SELECT arg_max(lift, next) FROM filled WHERE lift * next < 1), 1.0) AS kept_by, coalesce((SELECT tokens / fitted FROM sums WHERE fitted > 0), 1.0) AS whole_by),
chances AS MATERIALIZED (SELECT source, lang, topic, coalesce(least(ratio * kept_by, 1.0), 1.0) AS probability, coalesce(ratio * whole_by, 1.0) AS weight FROM ratios, scale),
drawn AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM facts JOIN chances USING (source, lang, topic))
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, source, lang, topic, round(probability, 6) AS probability, u < probability AS kept,
  round(weight, 6) AS weight, CAST(floor(weight) AS BIGINT) + CAST(u < weight - floor(weight) AS BIGINT) AS copies
FROM drawn""".replace(":share", str(mixing.KEPT_SHARE))


def _op11_sql(rules: tuple[url_rules.ListRule, ...] = URL_RULES, config: url_rules.Config = url_rules.EXACT) -> str:
    """List rules, then all token sets of up to ``max_tokens`` counted one by one."""
    part = lambda k: f"regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', {k})"
    lower = lambda text: f"translate({text}, '{url_rules.UPPER}', '{url_rules.LOWER}')"
    words = lambda text, mark: f"list_transform(regexp_extract_all({text}, '{url_rules.WORD}'), lambda w: '{mark}' || regexp_replace(w, '[0-9]+', '#', 'g'))"
    cases = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'name': '{r.name}', 'verdict': '{r.verdict}'}}" for r in sorted(rules, key=lambda r: -len(r.name))]
    sets, subsets = [], []
    for k in range(1, config.max_tokens + 1):
        chosen = ", ".join(f"items[i{j}]" for j in range(k))
        indexes = "".join(f", unnest_{j}(i{j})" for j in range(k)).replace("unnest_", "places p")
        ordered = " AND ".join([f"i{j} < i{j + 1}" for j in range(k - 1)] + [f"i{k - 1} <= len(items)"])
        sets.append(f"SELECT list_sort([{chosen}]) AS tokens, verdict FROM kept{indexes} WHERE {ordered}")
        subsets.append(k)
    most = f" QUALIFY place <= {config.vocabulary}" if config.vocabulary else ""
    first = f"[1:{config.max_items}]" if config.max_items else ""
    return rf"""WITH urls AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
parsed AS (SELECT page_id, u, {lower(part(1))} AS host, {part(2)} AS path, {part(2)} || {part(3)} AS tail FROM urls),
listed AS MATERIALIZED (
  SELECT *, list_distinct(list_concat({words('host', 'h:')}, {words(lower('tail'), 'p:')})) AS tokens, CASE {' '.join(cases)} END AS listed FROM parsed),
labelled AS MATERIALIZED (SELECT row_number() OVER () AS row_no, tokens, listed.verdict AS verdict FROM listed WHERE listed IS NOT NULL),
facts AS (SELECT count(*) AS total, count(*) FILTER (verdict = 'block') AS blocked, CAST(ceil(CAST({config.min_support} AS DOUBLE) * count(*)) AS BIGINT) AS least FROM labelled),
seen AS (SELECT token, count(*) AS n, count(*) FILTER (verdict = 'block') AS m FROM (SELECT unnest(tokens) AS token, verdict FROM labelled) GROUP BY token),
telling AS (
  SELECT token, row_number() OVER (ORDER BY abs(CAST(m AS HUGEINT) * total - CAST(n AS HUGEINT) * blocked) DESC, token) AS place
  FROM seen, facts WHERE n >= least{most}),
kept AS MATERIALIZED (
  SELECT row_no, verdict, list(token ORDER BY place){first} AS items
  FROM (SELECT row_no, verdict, unnest(tokens) AS token FROM labelled) JOIN telling USING (token) GROUP BY ALL),
places AS (SELECT unnest(range(1, (SELECT coalesce(max(len(items)), 0) + 1 FROM kept))) AS i),
sets AS MATERIALIZED ({' UNION ALL '.join(sets)}),
rules AS MATERIALIZED (
  SELECT s.tokens, verdict, support, 1000000 * support // n AS confidence
  FROM (SELECT tokens, verdict, count(*) AS support FROM sets GROUP BY ALL) s JOIN (SELECT tokens, count(*) AS n FROM sets GROUP BY ALL) w USING (tokens), facts
  WHERE support >= least AND 100 * support >= {config.min_percent} * n),
good AS MATERIALIZED (
  SELECT * FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules g WHERE g.verdict = r.verdict AND g.confidence >= r.confidence AND len(g.tokens) < len(r.tokens) AND list_has_all(r.tokens, g.tokens))),
best AS (
  SELECT page_id, u, arg_min(verdict, (-confidence, -support, -len(g.tokens), array_to_string(g.tokens, ' '), verdict)) AS learnt
  FROM (SELECT DISTINCT page_id, u, tokens FROM listed WHERE listed IS NULL) l JOIN good g ON list_has_all(l.tokens, g.tokens) GROUP BY page_id, u)
SELECT l.page_id, host, path, listed.name AS rule, coalesce(listed.verdict, learnt, 'allow') AS verdict, learnt
FROM listed l LEFT JOIN best b ON l.page_id IS NOT DISTINCT FROM b.page_id AND l.u = b.u"""


def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, y: xor(d >> 1, 3988292384 * (d & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: {step}), 4294967295)"


def _op12_sql(levels: int = 6) -> str:
    """The levels of a tree unrolled: enough for 8 ** ``levels`` rows of a language."""
    field = lambda f: f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    leaf = lambda **other: f"sha256({' || '.join(field(other.get(f, f)) for f in merkle_manifest.FIELDS)})"
    parts = [
        f"""base AS MATERIALIZED (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, {leaf()} AS leaf,
    CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(text=f"translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}')")} ELSE {leaf()} END AS start
  FROM documents)""",
        "t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, leaf AS h FROM base)",
    ]

    def climb(name: str, count: int, top: str) -> None:
        """Nodes ``{name}0 .. {name}{count}`` (grp, pos, n, h), then each row's folded and proof strings level by level."""
        for k in range(count):
            keep = "grp, pos, n, h" if k or name != "t" else "grp, pos, n, h"
            parts.append(
                f"{name}n{k + 1} AS MATERIALIZED (SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h"
                f" FROM (SELECT {keep} FROM {name if not k else f'{name}n{k}'}{0 if not k else ''}) GROUP BY grp, pos // 8, n)"
            )

    climb("t", levels, "subroot")
    parts.append(f"r0 AS MATERIALIZED (SELECT '' AS grp, grp AS own, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h FROM tn{levels})")
    climb("r", 2, "root")

    def sides(name: str, k: int) -> str:
        """Digests left and right of each node of a level, none where the level has one node."""
        source = f"{name}0" if not k else f"{name}n{k}"
        return (
            f"{name}s{k} AS MATERIALIZED (SELECT a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi, max(a.n) > 1 AS grows"
            f" FROM (SELECT grp, pos, n FROM {source}) a JOIN (SELECT grp, pos, h FROM {source}) b ON a.grp = b.grp AND a.pos // 8 = b.pos // 8 GROUP BY a.grp, a.pos)"
        )

    parts += [sides("t", k) for k in range(levels)] + [sides("r", k) for k in range(2)]
    parts.append("f0 AS (SELECT t0.*, r0.pos AS top, start AS f, '' AS proof FROM t0 JOIN r0 ON t0.grp = r0.own)")
    last = "f0"
    for name, own, count in (("t", "pos", levels), ("r", "top", 2)):
        group = "x.grp" if name == "t" else "''"
        for k in range(count):
            new = f"f{name}{k + 1}"
            parts.append(
                f"{new} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN s.grows THEN sha256(lo || f || hi) ELSE f END AS f, CASE WHEN s.grows THEN proof || lo || hi ELSE proof END AS proof)"
                f" FROM {last} x JOIN {name}s{k} s ON s.grp = {group} AND s.pos = x.{own} // {8 ** k})"
            )
            last = new
    return f"""WITH {', '.join(parts)}
SELECT x.doc_id, x.leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM {last} x JOIN tn{levels} s ON s.grp = x.grp CROSS JOIN rn2 r"""


def _op13_sql(config: phrase_mining.Config = phrase_mining.CONTRACT) -> str:
    cut = lambda k: f"list({{'score': {config.scale} * CAST(a AS HUGEINT) // (l.f + r.f), 'k': k, 'l': l.f, 'r': r.f}})"
    return rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents),
spoken AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spoken, (VALUES (1), (2), (3), (4)) AS sizes(k))),
counts AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {config.least}),
langs AS (SELECT lang, sum(len(w)) AS n FROM spoken GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, words_of, a, list_min({cut('k')}) AS best
  FROM (SELECT lang, phrase, words AS words_of, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cuts) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = lp JOIN counts r ON r.lang = c.lang AND r.phrase = rp GROUP BY ALL),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, words - k + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS k FROM candidates)) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts p ON s.lang = p.lang AND s.phrase = p.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {config.contained_percent} * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a, best.l AS l, best.r AS r, CAST(n AS BIGINT) AS n, CAST(best.score AS BIGINT) AS score
FROM kept JOIN langs USING (lang) QUALIFY rank <= {config.top}"""


ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op6_chat_format": _op6_sql(), "op9_exact_dedup": OP9_SQL, "op10_source_mixing": _op10_sql(), "op11_url_rules": _op11_sql(), "op12_merkle_manifest": _op12_sql(), "op13_phrase_mining": _op13_sql()}
