"""URL rules, Merkle manifest and phrase mining against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry_points
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import merkle_manifest, phrase_mining, url_rules
from quarrylog.llm.queries import URL_RULES
from tests.llm.test_operators import frame

PAGES = "page_id long, url string, host string, n long, token string, verdict string, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1, "y", "z", "w") for i, u in enumerate(urls)], PAGES)


def url_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)$", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2], m[2] + m[3]) if m else ("", "", "")


def url_tokens(url):
    host, _, tail = url_parts(url)
    tail = "".join(c.lower() if c.isascii() else c for c in tail)
    return {f"{k}:{re.sub('[0-9]+', '#', w)}" for k, text in (("h", host), ("p", tail)) for w in re.findall(r"[^\W_]+", text)}


def brute_urls(urls, config=url_rules.DEFAULT):
    def listed(url):
        host, path, _ = url_parts(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)) if fits else None

    rules = [listed(u) for u in urls]
    rows = [(url_tokens(u), r.verdict) for u, r in zip(urls, rules) if r]
    least, blocked = math.ceil(config.min_support * len(rows)), sum(v == "block" for _, v in rows)
    n, m = Counter(t for ts, _ in rows for t in ts), Counter(t for ts, v in rows if v == "block" for t in ts)
    telling = sorted((t for t in n if n[t] >= least), key=lambda t: (-abs(m[t] * len(rows) - n[t] * blocked), t))[: config.vocabulary]
    support, whole = Counter(), Counter()
    for ts, v in rows:
        items = sorted(sorted(ts & set(telling), key=telling.index)[: config.max_items])
        for k in range(1, config.max_tokens + 1):
            for s in itertools.combinations(items, k):
                support[s, v] += 1
                whole[s] += 1
    sure = {(s, v): (1_000_000 * c // whole[s], c) for (s, v), c in support.items() if c >= least and 100 * c >= config.min_percent * whole[s]}
    good = {
        (s, v): x for (s, v), x in sure.items()
        if not any((p, v) in sure and sure[p, v][0] >= x[0] for k in range(1, len(s)) for p in itertools.combinations(s, k))
    }
    out = []
    for u, r in zip(urls, rules):
        fits = [((-c, -n_, -len(s), " ".join(s), v), v) for (s, v), (c, n_) in good.items() if set(s) <= url_tokens(u)]
        learnt = min(fits)[1] if fits and not r else None
        out.append((*url_parts(u)[:2], r.name if r else None, r.verdict if r else learnt or "allow", learnt))
    return out


ODD_URLS = [None, "", "example.org/es/1", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://a://b.com/de/", "https://com/de/x", "x://xcom/de/", "http://a.org", "http://a.org?/es/", "http://example.org/en/17", "http://é.example.org/En/1\n2#é" + "z" * 5000]


def some_urls(n=400):
    rng = random.Random(5)
    make = lambda: f"http://{rng.choice(['www', 'm', 'win-bets'])}.{rng.choice(['shop', 'news'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(300)}{rng.choice(['', '?utm=1', '#top'])}"
    return [*ODD_URLS, *[make() for _ in range(n)], *["http://win-bets.shop.example.net/de/5"] * 200]


def test_url_rules_match_brute_force(spark):
    urls = some_urls()
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages(spark, urls), URL_RULES).collect()}
    expected = brute_urls(urls)
    assert [got[i] for i in range(len(urls))] == expected
    assert {"allow", "block"} <= {x[3] for x in expected if x[4]}  # rules of both kinds decide


def test_exact_url_rules_use_every_token(spark):
    """Only a pair of the least telling tokens of long urls decides: the bounded model drops it, the exact one finds it."""
    rng = random.Random(3)
    telling = [f"t{a}" for a in "abcdefghij"]
    rows = [(sorted([f"p:{t}" for t in telling]) + ["p:x"] * (i % 2) + ["p:y"] * (i % 2 == 1 or rng.random() < 0.5), "block") for i in range(60)]
    rows += [(["p:x"] * (i % 2) + ["p:y"] * (i % 2 == 0) + [f"p:{t}" for t in telling if rng.random() < 0.1] + ["h:a"], "allow") for i in range(200)]
    assert max(len(t) for t, _ in rows) > url_rules.DEFAULT.max_items
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    config = url_rules.EXACT
    least, support, whole = math.ceil(config.min_support * len(rows)), Counter(), Counter()
    for ts, v in rows:
        for k in range(1, config.max_tokens + 1):
            for s in itertools.combinations(sorted(ts), k):
                support[s, v] += 1
                whole[s] += 1
    sure = {(s, v): (1_000_000 * c // whole[s], c) for (s, v), c in support.items() if c >= least and 100 * c >= config.min_percent * whole[s]}
    good = {(s, v): x for (s, v), x in sure.items() if not any(sure.get((p, v), (-1,))[0] >= x[0] for k in range(1, len(s)) for p in itertools.combinations(s, k))}
    mined = lambda c: {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in url_rules.mine(frame, c).collect()}
    assert mined(config) == good and (("p:x", "p:y"), "block") in good
    assert (("p:x", "p:y"), "block") not in mined(url_rules.DEFAULT)


def test_exact_url_rules_of_the_query(spark):
    urls = some_urls()
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages(spark, urls), URL_RULES, config=url_rules.EXACT).collect()}
    assert [got[i] for i in range(len(urls))] == brute_urls(urls, url_rules.EXACT)
    assert url_rules.judge(pages(spark, ["http://a.org/x"]).limit(0), URL_RULES, config=url_rules.EXACT).count() == 0


def test_url_rules_of_given_labels(spark):
    labelled = spark.createDataFrame([(f"http://{h}.net/p/{i}", v) for i in range(30) for h, v in (("casino", "block"), ("news", "allow"))], "url string, verdict string")
    got = url_rules.judge(pages(spark, ["http://casino.net/q", "http://news.net/q", "http://other.net/q"]), (), labelled=labelled).orderBy("page_id").collect()
    assert [(r.verdict, r.learnt) for r in got] == [("block", "block"), ("allow", "allow"), ("allow", None)]


def test_url_rules_without_labels_or_rows(spark):
    assert [tuple(r)[1:] for r in url_rules.judge(pages(spark, ["http://a.net/x", None]), URL_RULES).orderBy("page_id").collect()] == [("a.net", "/x", None, "allow", None), ("", "", None, "allow", None)]
    assert url_rules.judge(pages(spark, ["http://a.org/x"]).limit(0), URL_RULES).count() == 0


def test_url_model_is_bounded(spark):
    """A long url that a third of the rows repeat adds no more sets than its most telling tokens make."""
    long = "http://a.com/de/" + "/".join(f"{a}{b}" for a in "abcdef" for b in "uvwxyz")
    items, _ = url_rules.transactions(spark.createDataFrame([(sorted(url_tokens(long)), "block")] * 50 + [(["h:a", "h:com"], "allow")] * 100, "tokens array<string>, verdict string"))
    assert items.agg(F.max(F.size("items"))).first()[0] == url_rules.DEFAULT.max_items + 1


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return H(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle_manifest.FIELDS])


def brute_tree(leaves):
    """Root, and the (left, right) digests of each leaf level by level."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(at):
            run, slot = runs[p // 8], p % 8
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = p // 8
        level = [H(*r) for r in runs]
    return (level[0] if level else None), steps


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["" if r["lang"] is None else "=" + r["lang"]].append(r)
    trees, out = {}, []
    for g, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees[g] = own, *brute_tree([brute_leaf(r) for r in own])
    names = sorted(trees, key=lambda g: g.encode())
    root, tops = brute_tree([trees[g][1] for g in names])
    for g, top in zip(names, tops):
        own, subroot, steps = trees[g]
        out += [(r["doc_id"], brute_leaf(r), subroot, root, tuple(s + top)) for r, s in zip(own, steps)]
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 0, "de": 1, None: 1}, {"en": 8}, {"en": 9, None: 2}, {"en": 1300, "de": 513, "": 64, None: 3, "É": 1}])
def test_manifest_matches_brute_force(spark, sizes):
    rng = random.Random(9)
    texts = [None, "", "ABC é", "x" * 30000, "same", "same"]
    rows = [(rng.choice([None, *range(2000)]), rng.choice(texts), lang, rng.choice([None, "s"]), rng.choice([None, 7]), 1, "g") for lang, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows + rows[: len(rows) // 4], "doc_id long, text string, lang string, source string, n_chars long, pos long, grp string")
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in merkle_manifest.manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest([r.asDict() for r in docs.collect()]), key=repr)


def test_manifest_many_groups(spark):
    rows = [(i, "t", f"l{i % 70}", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in merkle_manifest.manifest(docs).collect()]
    assert sorted(got) == sorted(brute_manifest([r.asDict() for r in docs.collect()]))


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle_manifest.manifest(docs).collect() == []


def test_tampering_is_seen(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry_points.queries()["op12_merkle_manifest"](spark, sf).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and re.search("[A-Z]", texts[r.doc_id] or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)


# --- phrase mining ---------------------------------------------------------------------------------------------------


def brute_phrases(docs, config):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= config.least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= config.contained_percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((config.scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[: config.top])]
    return sorted(out)


def spoken(rng, n):
    vocabulary = ["a", "B", "the", "Éa", "x1", "é", "q\x01", "k-l", "longer"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  "]) for _ in range(n))


SMALL = phrase_mining.Config(least=3, top=40, block_bytes=400, bucket_bytes=300, hot_per_bucket=1)


@pytest.mark.parametrize("config", [SMALL, phrase_mining.Config(least=3, top=40), phrase_mining.Config(least=2, top=2000, block_bytes=1, bucket_bytes=1 << 20, hot_per_bucket=2)])
def test_phrases_match_brute_force(spark, config):
    rng = random.Random(11)
    texts = [spoken(rng, rng.randrange(60)) for _ in range(40)] + [None, "", " .\n", "one", "hot pair of words " * 120, "hot pair of", "same text here", "same text here", "same text here"]
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in phrase_mining.mine(docs, config=config).collect())
    assert got and got == brute_phrases([(r.lang, r.text) for r in docs.collect()], config)


def test_hot_prefixes_are_spread(spark):
    """One pair, and one triple, before ever other words: their own count stays whole and what follows them is dealt out."""
    rng = random.Random(2)
    texts = [" ".join(f"in the {rng.choice(['first', 'last'])} w{rng.randrange(30)}" for _ in range(30)) for _ in range(30)]
    config = phrase_mining.Config(least=3, top=500, block_bytes=2000, bucket_bytes=2000, hot_per_bucket=4)
    docs = frame(spark, texts)
    found = phrase_mining.read_block(*_arrow(texts))
    assert any(len(h) for _, h, _ in phrase_mining.hot_prefixes(found, len(found.word) / 40))
    assert sorted(tuple(r) for r in phrase_mining.mine(docs, config=config).collect()) == brute_phrases([(r.lang, r.text) for r in docs.collect()], config)


def _arrow(texts):
    import pyarrow as pa

    return pa.array([t.encode() for t in texts], pa.binary()), pa.array(["en"] * len(texts))


def test_phrases_of_nothing(spark):
    assert phrase_mining.mine(frame(spark, ["x"]).limit(0)).collect() == []
    assert phrase_mining.mine(frame(spark, [None, ""])).collect() == []


def test_one_long_text(spark):
    docs = frame(spark, ["in the end of it all " * 60_000])
    rows = phrase_mining.mine(docs).collect()
    assert {r.phrase: r.a for r in rows}["in the end of"] == 60_000


def test_exact_score_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**15), ("en", "b", 1, 9 * 10**15), ("en", "a b", 2, 9 * 10**15 - 1)], "lang string, phrase string, words int, f long")
    assert phrase_mining.scored(counts).first().score == 2_000_000 * (9 * 10**15 - 1) // (18 * 10**15)


def test_sort_counts_like_a_dictionary():
    rng = np.random.default_rng(4)
    rows = rng.integers(1, 5, (phrase_mining.RECORD, 3000)).astype(np.int32)
    rows[0], rows[4][rng.random(3000) < 0.3], rows[6] = 0, 0, 2
    depth, at, n = phrase_mining.sort_suffixes(rows, 20)
    got = {tuple(rows[1 : d + 1, p].tolist()): c for d, p, c in zip(depth.tolist(), at.tolist(), n.tolist())}
    expected = Counter()
    for *w, c in rows[1:6].T.tolist():
        for k in (2, 3, 4):
            if 0 not in w[:k]:
                expected[tuple(w[:k])] += c
    assert got == {p: c for p, c in expected.items() if c >= 20}


# --- long words ------------------------------------------------------------------------------------------------------


def test_long_words_merge_alike():
    from quarrylog.llm import bpe
    from quarrylog.llm.queries import tokenizer_path
    from quarrylog.llm.word_pieces import library_tokenizer, tokenizer_text

    rng, text = random.Random(6), tokenizer_text(tokenizer_path())
    coder = bpe.WordBpe(text, library_tokenizer("long words", text))
    for alphabet in ("ab", "the", "abcdefghijklmnopqrstuvwxyz"):
        for n in (1, 2, 63, 64):
            symbols = coder.symbols("".join(rng.choices(alphabet, k=n)) + coder.suffix)
            assert coder.merged(symbols) == coder.merged_long(list(symbols))


def test_one_word_of_a_megabyte(spark):
    import time

    from quarrylog.llm import bpe
    from quarrylog.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    began = time.time()
    got = bpe.encode_decode(frame(spark, [text]), tokenizer_path()).first()
    assert time.time() - began < 60
    assert got.ids == library.encode(text, add_special_tokens=False).ids


# --- planted passages ------------------------------------------------------------------------------------------------


def test_planted_passages_by_length(spark):
    """Passages of over 50 words in several documents: those of 400 bytes and more go whole, shorter ones stay, as the contract has it."""
    from quarrylog.llm import suffix_dedup

    rng = random.Random(12)
    make = lambda n, size: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))
    short, long = make(55, 4), make(60, 8)
    assert len(short) < 400 <= len(long)
    own = [f"{make(40, 6)} # {make(40, 6)}" for _ in range(60)]
    texts = [t.replace("#", (short if k % 3 == 0 else long if k % 3 == 1 else "clean")) for k, t in enumerate(own)]
    left = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        gone = len(text) - len(left[k])
        # A few letters beside a passage may agree with another document's and go with it.
        assert (len(long) <= gone < len(long) + 16 and long not in left[k]) if k % 3 == 1 else left[k] == text
