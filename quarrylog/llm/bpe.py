"""BPE encoding by speculation and verification, and decoding.

For a word, greedy longest match proposes tokens. A proposal is the encoding if
every token encodes to itself and every adjacent pair of tokens encodes to that
pair; those checks are made for all adjacent pairs of a block at once (unique
pair keys against a memo). Only words with a failing pair are merged exactly.

Defined cases: a null text is empty and has no ids and an empty decoded text.
Special-token strings inside texts become their ids, as the library has it.
Repeated rows give repeated rows, an empty table an empty result. Extra columns
are ignored. Ids outside the vocabulary are skipped when decoding.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.word_pieces import PLAIN, blocks, expand, give_back_memory, library_tokenizer, memoised, packed, pieces_of, plain_word, tokenizer_text, worker_memo

SCHEMA = "doc_id long, ids array<int>, decoded string"
#: Symbols above which a word is merged over a heap.
LONG_WORD = 64
#: Verdicts on token pairs that a worker keeps; the frequent ones come first.
PAIR_ENTRIES = 500_000
#: Encoded pieces and words that a worker keeps. Executors may run more workers than tasks for a while, so they are kept small.
PIECE_ENTRIES, WORD_ENTRIES = 120_000, 60_000


class WordBpe:
    """A BPE vocabulary with an end-of-word suffix; the library only normalises and splits words."""

    def __init__(self, text: str, tokenizer):
        spec = json.loads(text)
        model = spec["model"]
        self.tokenizer = tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        # Symbols as numbers, 0 for unknown ones: a pair is one key, and its rank tells the number of what it becomes.
        symbols = dict.fromkeys([*self.vocab, *(s for a, b in self.ranks for s in (a, b, a + b))])
        self.number = {s: i for i, s in enumerate(symbols, 1)}
        self.step = len(symbols) + 1
        self.rank_of = {self.number[a] * self.step + self.number[b]: rank for (a, b), rank in self.ranks.items()}
        self.becomes = {rank: self.number[a + b] for (a, b), rank in self.ranks.items()}
        self.id_of = [None, *map(self.vocab.get, symbols)]
        #: Length of the longest token by its first three characters; what is not here has at most two.
        self.reach = {}
        for token in self.vocab:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.surface = {i: t for t, i in self.vocab.items()}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [None] * size
        for table in (self.vocab, self.special):
            for t, i in table.items():
                names[i] = t
        self.names = pa.array(names)
        self.size = size
        self.words: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.n_speculated = self.n_exact = 0

    def symbols(self, surface: str) -> list[str]:
        """The first symbols of a token or word: its characters, the last with the suffix if there is one."""
        if self.suffix and surface.endswith(self.suffix) and len(surface) > len(self.suffix):
            body = surface[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(surface)

    def merged(self, symbols: list[str]) -> tuple[int, ...]:
        """Exact merging: the pair of least rank first, leftmost among equals."""
        if len(symbols) > LONG_WORD:
            return self.merged_long(list(symbols))
        number, step, rank_of, becomes, id_of, never = self.number, self.step, self.rank_of, self.becomes, self.id_of, 1 << 30
        at_hand = [number.get(s, 0) for s in symbols]
        order = [rank_of.get(a * step + b, never) for a, b in zip(at_hand, at_hand[1:])]
        while order and (best := min(order)) < never:
            at = order.index(best)
            at_hand[at] = one = becomes[best]
            del at_hand[at + 1], order[at]
            if at:
                order[at - 1] = rank_of.get(at_hand[at - 1] * step + one, never)
            if at < len(order):
                order[at] = rank_of.get(one * step + at_hand[at + 1], never)
        return tuple([i for n in at_hand if (i := id_of[n]) is not None])

    def merged_long(self, symbols: list[str]) -> tuple[int, ...]:
        """The same merging for words of any length in n log n: a heap of pairs over a linked list of symbols."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at) for at, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            to = after[at]
            # Pairs of symbols that were merged meanwhile are out of date.
            if symbols[at] is None or to >= n or ranks.get((symbols[at], symbols[to])) != rank:
                continue
            symbols[at] += symbols[to]
            symbols[to] = None
            after[at] = to = after[to]
            if to < n:
                before[to] = at
                if (rank := ranks.get((symbols[at], symbols[to]))) is not None:
                    heappush(heap, (rank, at))
            left = before[at]
            if left >= 0 and (rank := ranks.get((symbols[left], symbols[at]))) is not None:
                heappush(heap, (rank, left))
        return tuple(self.vocab[s] for s in symbols if s in self.vocab)

    def proposed(self, word: str) -> tuple[int, ...] | None:
        """Greedy longest match; None if some part is in no token."""
        full, vocab, reach, out, at = word + self.suffix, self.vocab, self.reach, [], 0
        n, end = len(word), len(full)
        while at < n:
            far, token = at + reach.get(full[at : at + 3], 2), None
            if far >= end and (token := vocab.get(full[at:end])) is not None:
                out.append(token)
                break
            to = min(n - 1, far)
            while to > at and (token := vocab.get(full[at:to])) is None:
                to -= 1
            if token is None:
                return None
            out.append(token)
            at = to
        return tuple(out)

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) of tokens encodes to itself; checked once per distinct pair."""
        unique, back = np.unique(keys, return_inverse=True)
        known = self.pairs
        out = np.empty(len(unique), bool)
        for i, key in enumerate(unique.tolist()):
            ok = known.get(key)
            if ok is None:
                left, right = divmod(key, self.size)
                ok = self.merged(self.symbols(self.surface[left]) + self.symbols(self.surface[right])) == (left, right)
                if len(known) < PAIR_ENTRIES:
                    known[key] = ok
            out[i] = ok
        return out[back]

    def sound(self, token: int) -> bool:
        key = -1 - token
        if key not in self.pairs:
            self.pairs[key] = self.merged(self.symbols(self.surface[token])) == (token,)
        return self.pairs[key]

    def encode_words(self, words: list[str]) -> list[bytes]:
        proposals = [self.proposed(w) for w in words]
        lengths = np.fromiter((len(p) if p else 0 for p in proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals if p for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        good = np.array([p is not None for p in proposals], bool)
        if len(flat):
            unique, back = np.unique(flat, return_inverse=True)
            alone = np.fromiter((self.sound(t) for t in unique.tolist()), bool, len(unique))[back]
            good[owner[~alone]] = False
            inner = owner[1:] == owner[:-1]
            fits = self.compatible(flat[:-1][inner] * self.size + flat[1:][inner])
            good[owner[1:][inner][~fits]] = False
        self.n_speculated += int(good.sum())
        self.n_exact += int((~good).sum())
        return [packed(p if ok else self.merged(self.symbols(w + self.suffix))) for w, p, ok in zip(words, proposals, good.tolist(), strict=True)]

    def words_in(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of each white-space free text, by the library's normaliser and splitter."""
        normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        joined = normal(" ".join(texts))
        if joined.count(" ") != len(texts) - 1:  # white space outside ASCII inside a piece
            return [[w for w, _ in split(normal(t))] for t in texts]
        starts = np.cumsum([0] + [len(t) + 1 for t in joined.split(" ")])
        found = split(joined)
        at = np.searchsorted(starts, [o[0] for _, o in found], "right") - 1
        out: list[list[str]] = [[] for _ in texts]
        for i, (w, _) in zip(at.tolist(), found, strict=True):
            out[i].append(w)
        return out

    def plan(self, piece: str) -> list[int | str]:
        """A piece as special ids and texts that the library must split."""
        at, out = 0, []
        for m in self.special_pattern.finditer(piece):
            out += [piece[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, piece[at:]]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each white-space free text; frequent ones are encoded once per worker."""
        return memoised(self.whole, pieces, self.encode_new, PIECE_ENTRIES)

    def encode_new(self, pieces: list[str], step: int = 4096) -> list[bytes]:
        found = PLAIN.findall("\n".join(pieces))
        plain = [plain_word(letters) for letters, _, _ in found]
        others = list(dict.fromkeys(other for _, _, other in found if other))
        plans = [self.plan(p) for p in others]
        texts = [x for plan in plans for x in plan if isinstance(x, str)]
        split = iter([words for i in range(0, len(texts), step) for words in self.words_in(texts[i : i + step])])
        plans = [[next(split) if isinstance(x, str) else x for x in plan] for plan in plans]
        distinct = dict.fromkeys(plain) | dict.fromkeys(mark for _, mark, _ in found)
        distinct |= dict.fromkeys(w for plan in plans for x in plan if isinstance(x, list) for w in x)
        distinct.pop("", None)
        ids = dict(zip(distinct, memoised(self.words, list(distinct), self.encode_words, WORD_ENTRIES), strict=True))
        rest = {p: b"".join([y for x in plan for y in ([ids[w] for w in x] if isinstance(x, list) else [packed([x])])]) for p, plan in zip(others, plans, strict=True)}
        return [(ids[word] + ids[mark] if mark else ids[word]) if word else rest.get(other, b"") for word, (_, mark, other) in zip(plain, found, strict=True)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings joined by one space, as the library does for a tokenizer without decoder."""
        flat = ids.values
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, self.size))
        names = self.names.take(pc.if_else(inside, flat, None))
        return pc.binary_join(_without_nulls(ids.offsets, names), " ")


def _without_nulls(offsets: pa.Array, values: pa.Array) -> pa.ListArray:
    if not values.null_count:
        return pa.ListArray.from_arrays(offsets, values)
    valid = np.concatenate(([0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(valid[offsets.to_numpy()].astype(np.int32)), values.drop_null())


def word_bpe(text: str) -> WordBpe:
    """The encoder of a tokenizer file, built once per worker."""
    name = hashlib.sha256(text.encode()).hexdigest()
    memo = worker_memo("word_bpe")
    if name not in memo:
        memo[name] = WordBpe(text, library_tokenizer(name, text))
    return memo[name]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))  # one tokenizer file, not data

    def run(batches):
        give_back_memory()
        bpe = word_bpe(shared.value)
        for batch in batches:
            for part in blocks(batch, 1):
                pieces = pieces_of(part.column(1))
                ids, bounds = expand(pieces.codes, pieces.starts, bpe.encode_pieces(pieces.distinct))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, bpe.decode(lists)], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
