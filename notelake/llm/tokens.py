"""Token counts: the exact number of tokens at every prefix of a text.

For each text the operator stores one array, the change of the token count
with each further code point; its running sum at ``i`` is what the tokenizer
gives for ``text[:i]``.  Counts, truncation to a budget and the cost of any cut
then need no second encoding.

The array comes from dynamic programming over the bytes of a pre-token: the
last token of a prefix is the one token that ends there and that may follow the
last token of the prefix before it (byte-pair merges give one such chain only),
so ``count[i] = count[i - len(token)] + 1``.  Words repeat, so a worker keeps the
arrays of the words it has met and a text is their concatenation.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words a worker keeps the arrays of; at that number it starts anew.
KEPT_WORDS = 900_000
#: Characters of the texts that a worker takes at once.
OUT_CHARS = 5 << 20

#: White space of the libraries' patterns: fixed values.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Texts are cut into words before space, \n, \t and \r, where the character before is no white space for any
#: library (\x1c to \x1f are for Python only): no pre-token spans such a place, and none before it looks past it.
_RARE = "".join(c for c in _SPACE if c not in " \n\t\r") + "\x1c\x1d\x1e\x1f"
_HAS_RARE = re.compile(f"[{_RARE}]")
_WORDS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_WORDS_RARE = re.compile(rf"[\s\S]*?[^ \n\t\r{_RARE}](?=[ \n\t\r]|\Z)|[\s\S]+\Z")


def cut_words(text: str) -> list[str]:
    """``text`` in pieces that byte-level BPE encodes independently; their concatenation is ``text``."""
    return (_WORDS_RARE if _HAS_RARE.search(text) else _WORDS).findall(text)


#: Texts of these characters only are cut by a pattern of our own into pre-tokens, which repeat more than words do.
#: Runs of white space stay with what follows them, as the run's last character may go either way.
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_NOT_PLAIN = re.compile(f"[^\\x00-\xff]|[{_RARE}]")
_PIECES = re.compile(rf"[ \n\t\r]{{2,}}[^ \n\t\r]*|'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^ \n\t\r{_LETTER}{_DIGIT}]+|[ \n\t\r]")


#: Where a single space isn't the only white space around it, cutting at each space will not do.
_BESIDE = ("  ", " \n", "\n ", "\t", "\r", *_RARE)


def _simple(text: str) -> bool:
    """Whether the text can be cut at each space: plain characters, and no other white space beside a space."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(x in text for x in _BESIDE)


class _Kept(dict):
    """text -> changes of the token count with its characters, little-endian int16."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        counts = self.make(text)
        made = array("h", map(sub, counts[1:], counts)).tobytes()
        if len(text) <= 256:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[text] = made
        return made


class _Joined(dict):
    """word -> the same for a space and the word."""

    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        return b"".join(map(self.counter.of_piece, _PIECES.findall(" " + word)))


class PrefixCounter:
    """Token counts at all prefixes, for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocab = set(self.tokenizer.get_vocab(with_added_tokens=False))
        self.bytes = str.maketrans({c: "".join(p for p, _ in self.split(c)) for c in map(chr, range(256))})
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: For each token, whether another may follow it, as far as that was asked.
        self.follow: dict[str, dict[str, bool]] = {t: {} for t in self.vocab}
        self.words, self.pieces = _Kept(self.word), _Kept(self.piece)
        self.spaced = _Joined(self)
        self.before: dict[str, bytes] = {}
        # The longest token that ends with three given characters; others have two at most.
        self.ending: dict[str, int] = {}
        for t in self.vocab:
            if len(t) > 2:
                self.ending[t[-3:]] = max(len(t), self.ending.get(t[-3:], 0))

    def _learn_pair(self, a: str, b: str) -> bool:
        ok = self.follow[a][b] = [t.value for t in self.tokenizer.model.tokenize(a + b)] == [a, b]
        return ok

    def extend(self, piece: str, last: list[str], count: list[int]) -> None:
        """Carry the last tokens and the counts of a pre-token's first prefixes on to all; piece is in the byte alphabet."""
        follow, ending = self.follow, self.ending.get
        for i in range(len(last), len(piece) + 1):
            for j in range(max(0, i - ending(piece[i - 3 : i], 2)) if i > 2 else 0, i):
                t = piece[j:i]
                if t in follow:
                    if j:
                        ok = follow[last[j]].get(t)
                        if ok is None:
                            ok = self._learn_pair(last[j], t)
                        if not ok:
                            continue
                    last.append(t)
                    count.append(count[j] + 1)
                    break

    def chain(self, piece: str) -> list[int]:
        self.extend(piece, [""], count := [0])
        return count

    @staticmethod
    def _by_char(piece: str, counts: list[int]) -> list[int]:
        if len(counts) > len(piece) + 1:  # some characters have more than one byte
            return [0, *(counts[at] for at in accumulate(len(c.encode()) for c in piece))]
        return counts

    @staticmethod
    def _plain(piece: str) -> bool:
        return piece[0] != "'" and not (len(piece) > 1 and piece[1] in " \n\t\r")

    def piece(self, piece: str) -> list[int]:
        """As ``word``, for what ``_PIECES`` finds."""
        return self._by_char(piece, self.chain(piece.translate(self.bytes))) if self._plain(piece) else self.word(piece)

    def of_piece(self, piece: str) -> bytes:
        """Changes of what ``_PIECES`` finds; those that begin with a space are kept with the words."""
        if piece[0] == " " and self._plain(piece):
            got = self.spaced.get(piece[1:])
            if got is None:
                counts = self.piece(piece)
                got = array("h", map(sub, counts[1:], counts)).tobytes()
            return got
        return self.pieces[piece]

    def learn(self, words: set[str]) -> None:
        """Get words ready that follow a space.  Their pre-tokens go in order: each goes on from what it shares with the one before."""
        spaced = self.spaced
        fresh = words.difference(spaced)
        if len(spaced) + len(fresh) > KEPT_WORDS // 2:  # what is in use moves over, the rest is forgotten
            self.before, self.spaced = spaced, _Joined(self)
            spaced, fresh = self.spaced, words
        for w in fresh & self.before.keys():
            spaced[w] = self.before[w]
        fresh = fresh.difference(spaced)
        cut, whole = {}, []
        for w in fresh:
            if len(w) <= 256:
                own = _PIECES.findall(" " + w)
                if len(own) == 1 and w and self._plain(own[0]):
                    whole.append(w)
                else:
                    cut[w] = own
        first = {own[0][1:] for own in cut.values() if own[0][0] == " " and len(own[0]) > 1 and self._plain(own[0])}
        whole = sorted(first.difference(spaced).union(whole))
        last, count, before, table = [""], [0], "", self.bytes
        for w in whole:
            piece, k = f" {w}".translate(table), 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self.extend(piece, last, count)
            counts, before = count if len(piece) == len(w) + 1 else self._by_char(f" {w}", count), piece
            spaced[w] = array("h", map(sub, counts[1:], counts)).tobytes()
        for w, own in cut.items():
            spaced[w] = b"".join(map(self.of_piece, own))

    def many(self, texts: list[str]) -> list[bytes]:
        """``changes`` of several texts."""
        cut = [t.split(" ") if _simple(t) and not (self.cut and self.cut.search(t)) else None for t in texts]
        self.learn(set().union(*(c[1:] for c in cut if c)))
        return [self.changes(t) if c is None else self._of_cut(c) for t, c in zip(texts, cut, strict=True)]

    def _of_cut(self, words: list[str]) -> bytes:
        return b"".join((*map(self.of_piece, _PIECES.findall(words[0])), *map(self.spaced.__getitem__, words[1:])))

    def word(self, word: str) -> list[int]:
        """Counts at the prefixes of 0 to len(word) characters of ordinary text."""
        out, base, run = [0], 0, None
        for piece, (start, end) in self.split(word):
            chain, at = self.chain(piece), 0
            for i in range(start, end):
                at += len(word[i].encode())
                if word[i] in _SPACE:
                    # Before a visible character a run of white space gives up its last one; as a prefix it is whole.
                    if run is None:
                        stop = next((k for k in range(i, len(word)) if word[k] not in _SPACE), len(word))
                        run = (i, out[i], self.chain(self.split(word[i:stop])[0][0]), np.cumsum([0, *(len(c.encode()) for c in word[i:stop])]))
                    first, before, counts, size = run
                    out.append(before + counts[size[i + 1 - first]])
                else:
                    run = None
                    out.append(base + chain[at])
            if end - start == 3 and word[start] == "'":  # a contraction such as 're is two pre-tokens before its last letter
                out[start + 2] = base + sum(self.chain(p)[-1] for p, _ in self.split(word[start : start + 2]))
            base += chain[-1]
        return out

    def ordinary(self, text: str) -> bytes:
        if _simple(text):
            return self._of_cut(text.split(" "))
        if not _NOT_PLAIN.search(text):
            return b"".join(map(self.of_piece, _PIECES.findall(text)))
        return b"".join(map(self.words.__getitem__, cut_words(text)))

    def changes(self, text: str) -> bytes:
        """The change of the token count with each character of ``text``, little-endian int16."""
        if self.cut is None or not self.cut.search(text):
            return self.ordinary(text)
        out, parts = [], self.cut.split(text)
        for ordinary, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            # Short of its last character a special string is ordinary text; with it, it is one token.
            got = np.frombuffer(self.ordinary(ordinary + special[:-1]), "<i2")
            out.append(got.tobytes())
            if special:
                out.append(np.array([1 - got[len(ordinary) :].sum()], "<i2").tobytes())
        return b"".join(out)


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    """One per worker process and file."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", changes: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, changes)`` of every row; ``changes`` answers for every prefix.

    With ``changes=False`` they stay in the task, and the column is left out.

    ``tokenizer`` names a file of the public tokenizers, found anew on each
    executor.  Special strings inside a text are special tokens, as is the
    library's default; none are added.  A null text counts as empty: no tokens,
    no changes.  Ids may be null or repeat; each row is answered by itself.
    Other columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(tokenizer))
        names = ["doc_id", "n_bytes", "n_tokens", *(["changes"] if changes else [])]
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, size = 0, pc.utf8_length(texts).fill_null(0).to_pylist()
            while at < len(ids):
                end, held = at + 1, size[at]
                while end < len(ids) and held + size[end] <= OUT_CHARS:
                    held += size[end]
                    end += 1
                part = [t or "" for t in texts[at:end].to_pylist()]
                every = count.many(part)
                n_bytes = pa.array([len(t.encode()) for t in part], pa.int64())
                n_tokens = pa.array([int(np.frombuffer(c, "<i2").sum(dtype=np.int64)) for c in every], pa.int64())
                yield pa.RecordBatch.from_arrays([ids[at:end], n_bytes, n_tokens, *([pa.array(every, pa.binary())] if changes else [])], names)
                at = end

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return known.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long" + (", changes binary" if changes else ""))


def tokens_at(changes: Column, n_chars: Column) -> Column:
    """Token count of the first ``n_chars`` characters, from a row's ``changes``."""

    @F.pandas_udf("long")
    def at(c, n):
        return c.combine(n, lambda x, k: int(np.frombuffer(x, "<i2")[: max(0, k)].sum(dtype=np.int64)))

    return at(changes, n_chars)


def chars_within(changes: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens: ``substring(text, 1, chars)`` is the truncation."""

    @F.pandas_udf("long")
    def within(c, n):
        def one(x, k):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(x, "<i2"), dtype=np.int64) <= k)
            return int(fits[-1]) + 1 if len(fits) else 0

        return c.combine(n, one)

    return within(changes, budget)
