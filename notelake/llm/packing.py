"""Vector best-fit packing of documents into training sequences.

A document becomes its token ids and one closing id.  Only a document longer
than a sequence is cut, into pieces of a full sequence and a rest.  Full pieces
are sequences as they are; the others are packed: longest first, each into the
open sequence that it fits best.  A sequence has three capacities, tokens,
documents and attention cost (the sum of squared piece lengths); a piece goes
only where all three hold, and among those to the sequence with the largest
weighted dot product of its demand with what is left, or the smallest weighted
norm of what would be left.

Pieces are dealt to shards of a bounded number of documents, each packed by one
task, so no task grows with the input; a shard wastes less than one sequence.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words, and pre-tokens, that a worker keeps the ids of; beyond that number it forgets the half not in use.
KEPT_WORDS = 600_000
#: Documents of a shard, about.
SHARD_DOCS = 10_000
#: Characters of the texts that a worker takes at once.
_CHUNK_CHARS = 8 << 20


#: Texts of plain characters are lower-cased here and cut into pre-tokens, and line ends, by a pattern of our own.
_LETTER, _DIGIT = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^ \n\t\r{_LETTER}{_DIGIT}]+|\n")
_AWKWARD = ("<|", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


def _plain(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(x in text for x in _AWKWARD)


def _taken(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``ids`` one after another; run k is ``ids[ends[k] : ends[k + 1]]``, and so it is in the result."""
    begin = ends[which]
    count = ends[which + 1] - begin
    out = np.concatenate([[0], np.cumsum(count)])
    return ids[np.arange(out[-1]) + np.repeat(begin - out[:-1], count)], out


class KeptIds:
    """Ids of strings, kept in columns; beyond ``most`` strings the half that was asked for last stays."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most, self.calls = learn, most, 0
        self.words, self.used = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def get(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids of distinct ``words``."""
        self.calls += 1
        found = pc.index_in(words, value_set=self.words)
        fresh = words.filter(found.is_null())
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            place[place < 0] = len(self.words) + np.arange(len(fresh))
            ids, ends = self.learn(fresh)
            self.words, self.used = pa.concat_arrays([self.words, fresh]), np.concatenate([self.used, np.empty(len(fresh), np.int64)])
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        self.used[place] = self.calls
        got = _taken(self.ids, self.ends, place)
        if len(self.words) > self.most:
            stay = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
            self.words, self.used = self.words.take(pa.array(stay)), self.used[stay]
            self.ids, self.ends = _taken(self.ids, self.ends, stay)
        return got


class WordIds:
    """Token ids of texts for a tokenizer that lower-cases, drops white space and marks the ends of pre-tokens.

    Pre-tokens are independent, so each is encoded once; new ones go through the
    library together and are told apart by their last tokens.  Texts with other
    than plain characters are cut at white space and their words encoded whole.
    Words of many texts are told apart and put together in columns.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.words = KeptIds(self._from_pieces, KEPT_WORDS)
        self.pieces = KeptIds(self._from_library, KEPT_WORDS)
        self.whole = KeptIds(self._whole, KEPT_WORDS // 2)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for at in range(0, len(words), 5000):
            for e in self.tokenizer.encode_batch_fast(words.slice(at, 5000).to_pylist(), add_special_tokens=False):
                ids.append(np.array(e.ids, "<u4"))
                counts.append(len(ids[-1]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def _from_library(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, ends, held = [], [np.zeros(1, np.int64)], 0
        for at in range(0, len(pieces), 20_000):
            part = pieces.slice(at, 20_000)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            own = np.flatnonzero(self.last[ids]) + 1
            if len(own) != len(part):
                ids, own = self._whole(part)
                own = own[1:]
            parts.append(ids)
            ends.append(own + held)
            held += len(ids)
        return np.concatenate(parts), np.concatenate(ends)

    def _from_pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = pa.array(_PIECES.findall("\n" + "\n".join(words.to_pylist())), pa.large_string()).dictionary_encode()
        which = found.indices.to_numpy()  # 0 is the line end before each word, which has no ids
        ids, ends = np.empty(0, "<u4"), np.zeros(1, np.int64)
        if len(found.dictionary) > 1:
            ids, ends = self.pieces.get(found.dictionary.slice(1))
        ids, ends = _taken(ids, np.concatenate([[0], ends]), which)
        return ids, np.concatenate([ends[np.flatnonzero(which == 0)], ends[-1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        plain = [_plain(t) for t in texts]
        got = [b""] * len(texts)
        for side, kept in ((True, self.words), (False, self.whole)):
            rows = [i for i, p in enumerate(plain) if p is side]
            if not rows:
                continue
            lines = ((texts[i].lower() if side else texts[i]).replace("\n", " ") for i in rows)
            cut = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
            words = cut.values.dictionary_encode()
            ids, ends = _taken(*kept.get(words.dictionary), words.indices.to_numpy())
            ends = ends[cut.offsets.to_numpy()].tolist()
            for i, start, end in zip(rows, ends, ends[1:], strict=False):
                got[i] = ids[start:end].tobytes()
        return got


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut where longer than ``length``.

    The tokenizer must drop white space (its words are independent).  Special
    strings inside a text become special ids, as is the library's default; none
    are added.  A null text counts as empty: one piece, the closing id.  Rows
    that repeat an id, and rows without one, are documents of their own.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(public_tokenizers.path(tokenizer)).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < len(ids):
                part, held = [], 0
                while at + len(part) < len(ids) and (not part or held < _CHUNK_CHARS):
                    part.append(texts[at + len(part)].as_py() or "")
                    held += len(part[-1])
                rows: list[tuple] = []
                for doc, got in zip(ids[at : at + len(part)], encode(part), strict=True):
                    got += end
                    for k, start in enumerate(range(0, len(got), 4 * length)):
                        own = got[start : start + 4 * length]
                        rows.append((doc, k, start // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                at += len(part)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = known.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def vector_best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.  Capacities and weights: tokens, documents, attention cost.

    ``rule``: "norm" takes the bin with the smallest weighted norm of what would
    be left, "dot" the one with the largest weighted dot product of demand and
    what is left.  A bin that even the shortest item left overfills is closed.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1).astype(float)
    cap, w = np.array(capacity, float), np.array(weights, float)
    cap_w = w / cap**2
    if n and (demand.max(0) > cap).any():
        raise ValueError("an item is larger than a bin")
    bin_of, offset, bins = np.empty(n, np.int64), np.empty(n, np.int64), 0
    shortest = lengths.min() if n else 0
    # Bins in preallocated arrays; `m` of them are open.
    room, name, m = np.empty((1024, 3)), np.empty(1024, np.int64), 0
    for i in order.tolist():
        d = demand[i]
        best = -1
        if m:
            rest = room[:m] - d
            fits = rest.min(1) >= 0
            if fits.any():
                score = (rest * rest) @ cap_w if rule == "norm" else -(room[:m] @ (cap_w * d))
                score[~fits] = np.inf
                best = int(score.argmin())
        if best < 0:
            if m == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            room[m], name[m], best = cap, bins, m
            m, bins = m + 1, bins + 1
        bin_of[i], offset[i] = name[best], int(cap[0] - room[best, 0])
        room[best] -= d
        if room[best, 0] < shortest or room[best, 1] < 1:
            m -= 1
            room[best], name[best] = room[m], name[m]
    return bin_of, offset


def pack(pieces: DataFrame, length: int = 2048, max_docs: int | None = None, max_cost: float | None = None, shards: int = 1, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``, which replace columns of these names; extra columns stay.

    ``max_docs`` and ``max_cost`` (sum of squared lengths) bound a sequence
    beside its tokens; left out, they can't bind.  Full pieces keep to
    themselves.  Sequence ids are unique, not dense.  No rows in, no rows out.
    """
    cap = (float(length), float(max_docs or length), float(max_cost or length * length))

    def each(table: pa.Table) -> pa.Table:
        shard = table.column("__shard")[0].as_py()
        table = table.drop_columns(["__shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offset = vector_best_fit(table.column("length").to_numpy(), cap, weights, rule)
        return table.append_column("sequence_id", pa.array(shard * (1 << 32) + bins)).append_column("offset", pa.array(offset))

    pieces = pieces.drop("sequence_id", "offset", "__shard")
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(shards)).cast("long"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pieces.dtypes), "sequence_id long", "offset long"])
    return dealt.repartition(shards, "__shard").groupBy("__shard").applyInArrow(each, schema)


def pack_documents(docs: DataFrame, length: int = 2048, tokenizer: str = "word_bpe_49k.json", **limits) -> DataFrame:
    """Tokenize and pack; one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls, repeats and missing ids as ``pieces`` has it; of equal pieces any
    comes first; no rows in, no rows out.  Without ``max_docs`` and ``max_cost``
    only tokens bind: fewest sequences is then what the other two are for.
    """
    shards = max(1, math.ceil(docs.count() / SHARD_DOCS))
    return pack(pieces(docs, tokenizer, length), length, shards=shards, **limits)
