"""Texts as codes into a block's distinct white-space pieces.

The word tokenizers' patterns never cross ASCII white space and ASCII white
space is dropped, so what a piece becomes does not depend on its neighbours.
Working once per distinct piece of a block replaces a shuffle of
(document, piece, frequency) rows, which would be several times the texts.
"""

from __future__ import annotations

import ctypes
import re
import sys
from array import array
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 3 << 20
MEMO_ENTRIES = 150_000
WHOLE_ENTRIES = 250_000
M_MMAP_THRESHOLD = -3  # of mallopt(3)


class Pieces(NamedTuple):
    """``codes[starts[i]:starts[i + 1]]`` are text ``i``'s pieces, as indexes of ``distinct``."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: list[str]


def pieces_of(texts: pa.Array) -> Pieces:
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    starts = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    return Pieces(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist())


def blocks(batch: pa.RecordBatch, text_at: int, limit: int = BLOCK_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each (one long text may be more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back_memory(*memos: str) -> None:
    """Large arrays of this worker go back to the system once they are freed, so two workers and the executor's heap fit side by side.

    With ``memos``, the worker keeps only those: it may have served another
    operator before, whose tokenizers and pieces are of no use to this one.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    if memos:
        held = vars(sys).get("_quarrylog_memos", {})
        for name in set(held).difference(memos):
            del held[name]
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(M_MMAP_THRESHOLD, 2 << 20)
    if memos and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def worker_memo(name: str) -> dict:
    """A dict that lives as long as the Python worker process, for tokenizers and encoded pieces."""
    return vars(sys).setdefault("_quarrylog_memos", {}).setdefault(name, {})


def memoised(memo: dict, keys: list[str], make, limit: int = MEMO_ENTRIES) -> list:
    """``make(missing keys)`` beside what the memo holds; once full, the memo keeps what came first (the frequent keys)."""
    out = list(map(memo.get, keys))
    missing = [i for i, v in enumerate(out) if v is None]
    if not missing:
        return out
    absent = [keys[i] for i in missing]
    made = make(absent)
    for i, v in zip(missing, made, strict=True):
        out[i] = v
    if room := max(0, limit - len(memo)):
        memo.update(islice(zip(absent, made), room))
    return out


def packed(ids) -> bytes:
    """Ids as 32-bit integers in one bytes object, the cheapest form to keep many of."""
    return array("i", ids).tobytes()


def expand(codes: np.ndarray, starts: np.ndarray, per_piece: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids start (one more entry at the end)."""
    lengths = np.fromiter(map(len, per_piece), np.int64, len(per_piece)) >> 2
    flat = np.frombuffer(b"".join(per_piece), np.int32)
    first = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(first[codes] - (ends - n), n)
    bounds = np.concatenate(([0], ends))[starts]
    return flat[at], bounds


#: For pieces on lines of their own: a word of ASCII or Latin-1 letters, then at most one full stop or comma, or any other
#: piece. Such letters are composed already, their lower case is settled, and the tokenizer's pattern cuts between the
#: letters and the mark.
PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)|(.*))$", re.MULTILINE)
_OWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
BYTE_SYMBOLS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_OWN))}


def plain_word(letters: str) -> str:
    """The byte-level form of a word that ``PLAIN`` matched."""
    word = letters.lower()
    return word if word.isascii() else "".join(map(BYTE_SYMBOLS.__getitem__, word.encode()))


#: For pieces on lines of their own: a plain word as in ``PLAIN``, then ASCII marks, or any other piece. The tokenizer's
#: pattern cuts between letters and marks and leaves a run of marks whole.
PARTS = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)


class LibraryPieces:
    """Packed ids of white-space free texts by the tokenizer's library; plain words go straight to its model."""

    def __init__(self, tokenizer, name: str):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.whole, self.stems, self.marks = (worker_memo(f"{kind}:{name}") for kind in ("whole", "stems", "marks"))

    def __call__(self, pieces: list[str]) -> list[bytes]:
        return memoised(self.whole, pieces, self._of_parts, WHOLE_ENTRIES)

    def _of_parts(self, pieces: list[str]) -> list[bytes]:
        found = PARTS.findall("\n".join(pieces))
        stems = [stem.lower() for stem, _, _ in found]
        ids = self._each(stems, lambda new: memoised(self.stems, new, self._of_words))
        ends = self._each([mark for _, mark, _ in found], lambda new: memoised(self.marks, new, self._of_texts))
        others = self._each([other for _, _, other in found], self._of_texts)
        return [(ids[stem] + ends[mark] if mark else ids[stem]) if stem else others.get(other, b"") for stem, (_, mark, other) in zip(stems, found, strict=True)]

    def _each(self, parts: list[str], make) -> dict[str, bytes]:
        distinct = dict.fromkeys(parts)
        distinct.pop("", None)
        return dict(zip(distinct, make(list(distinct)), strict=True))

    def _of_words(self, words: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return [packed([t.id for t in tokenize(w if w.isascii() else plain_word(w))]) for w in words]

    def _of_texts(self, texts: list[str]) -> list[bytes]:
        return [packed(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read where the job is set up."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def library_tokenizer(name: str, text: str):
    """The library's tokenizer, built once per worker, without truncation or padding."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memo = worker_memo("tokenizers")
    if name not in memo:
        memo[name] = Tokenizer.from_str(text)
        memo[name].no_truncation()
        memo[name].no_padding()
    return memo[name]
