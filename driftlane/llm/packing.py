"""Packing by power-of-two decomposition.

A document's tokens (with an end token) are cut into pieces whose lengths are
powers of two, at most SEQUENCE: as many whole sequences as fit, then the
binary digits of the rest from large to small. Each piece is a sequence of its
own, kept in the bucket of its length, so a batch drawn from one bucket needs
no padding and no sequence crosses documents. That needs no shuffle at all:
each document is cut where it is read.

Tokens come from the tokenizer file at the given path. Since its rules never
join anything across white space, the tokens of a text are those of its
white-space separated chunks in order. A worker process remembers the tokens of
chunks, bounded by MEMO chunks and MEMO_CHARS characters (some 50 MB): where it
is full, chunks that came only once since the last time go. The bound changes
what is computed twice, never a result.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each; a null doc_id stays null; any length of text is packed whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import pairwise, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import tidied

SEQUENCE = 2048
END = 1
#: Chunks and characters that one worker process remembers, and texts and bytes that are tokenized together.
MEMO, MEMO_CHARS, GROUP, GROUP_BYTES = 150_000, 3_500_000, 2048, 6 << 20
#: Chunks on which a tokenizer must show that it parts letters from a run of symbols and sends each to its model as bytes.
_PROBES = ("a", "tokenizer", "qxzzyvk", "na\u00efvet\u00e9", "gr\u00f6\u00dfe***", "\u017eilje", "end.)", "%%%")
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u024f]*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Chunks:
    """Tokens of white-space separated chunks, each tokenized once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.plain = all(self._plain(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES)
        self.reset()

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()]))]

    def _plain(self, chunk: str) -> list[int] | None:
        """Tokens of letters with symbols behind them; None for other chunks."""
        if chunk.isascii() and chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.lower())]
        found = _PLAIN.fullmatch(normalize("NFC", chunk).lower())
        if not found:
            return None
        word, tail = found.groups()
        return (self._model(word) if word else []) + (self._model(tail) if tail else [])

    def reset(self):
        self.index: dict[str, int] = {}
        self.length, self.start = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)
        self.open = np.zeros(1 << 12, bool)  # whether a stop set right behind the chunk could be part of its last token
        self.again = np.zeros(1 << 12, bool)  # whether the chunk was met again after it was learnt
        self.ids, self.used, self.chars = np.zeros(1 << 16, np.int32), 0, 0

    def _add(self, chunks: list[str], lengths: np.ndarray, ids: np.ndarray):
        k, n = len(self.index), len(chunks)
        while k + n > len(self.length):
            self.length, self.start, self.open, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start, self.open, self.again))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[k : k + n] = lengths
        self.start[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.index.update(zip(chunks, range(k, k + n), strict=True))

    def trim(self):
        """Keeps the chunks met again since the last time; all go if these are nearly all."""
        if len(self.index) <= MEMO and self.chars <= MEMO_CHARS:
            return
        kept = np.flatnonzero(self.again[: len(self.index)])
        names, length, start, opened, ids = list(self.index), self.length, self.start, self.open, self.ids
        self.reset()
        if len(kept) > 3 * MEMO // 4 or sum(len(names[i]) for i in kept) > 3 * MEMO_CHARS // 4:
            return
        n = length[kept].astype(np.int64)
        self._add([names[i] for i in kept], n, ids[np.repeat(start[kept] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        self.open[: len(kept)] = opened[kept]

    def learn(self, new: list[str]):
        # most chunks go to the model at once; the rest goes through the whole tokenizer
        found = [self._plain(c) for c in new] if self.plain else [None] * len(new)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([new[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = e.ids
        k = len(self.index)
        self._add(new, np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.int32))
        self.open[k : k + len(new)] = [c != "" and not is_letter_or_number(c[-1] if c.isascii() else normalize("NFC", c).lower()[-1]) for c in new]

    def _places(self, distinct: list[str]) -> np.ndarray:
        """Numbers of distinct chunks; unknown ones are learnt."""
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(unknown):
            at[unknown] = len(self.index) + np.arange(len(unknown))
            self.learn([distinct[i] for i in unknown])
        return at

    def _chunks(self, texts: pa.Array, stops: bool) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts in a row, and where each text's begin (and the last ends)."""
        split = split_chunks(texts, stops)
        coded = split.values.dictionary_encode()
        return self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()], split.offsets.to_numpy().astype(np.int64)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and where each chunk's begin (and the last ends)."""
        length = self.length[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(self.start[at] - ends[:-1], length) + np.arange(ends[-1])], ends

    def _doubtful(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of texts where a stop was split off that could belong to the token before it."""
        stop = np.isin(at[1:], [self.index.get(c, -1) for c in ".,"])
        where = np.flatnonzero(self.open[at[:-1]] & stop) + 1
        own = np.searchsorted(first, where, side="right") - 1
        return np.unique(own[first[own] < where])  # a stop that begins a text has nothing before it

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text (no nulls), with the end token."""
        self.trim()
        at, first = self._chunks(texts, True)
        doubtful = self._doubtful(at, first).tolist()
        ids, ends = self._ids(at)
        out = [ids[a:b] for a, b in pairwise(ends[first].tolist())]
        if doubtful:
            ids, ends = self._ids((again := self._chunks(texts.take(pa.array(doubtful)), False))[0])
            for i, (a, b) in zip(doubtful, pairwise(ends[again[1]].tolist()), strict=True):
                out[i] = ids[a:b]
        return [np.append(x, np.int32(END)) for x in out]


def is_letter_or_number(c: str) -> bool:
    return c.isalpha() or c.isnumeric()


def split_chunks(texts: pa.Array, stops: bool = True) -> pa.ListArray:
    """Chunks whose tokens, in order, are those of each text. With stops, a full stop or comma before a space is a chunk of
    its own, which is right unless a symbol stands before it. Lower-casing A-Z only makes chunks repeat more often; texts
    that could hold special tokens stay as they are."""
    texts = pc.replace_substring(texts, "\n", " ")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    if stops:
        texts = pc.replace_substring(pc.replace_substring(texts, ". ", " . "), ", ", " , ")
    return pc.split_pattern(texts, " ")


def kept_chunks(path: str) -> Chunks:
    """The worker process's memo: it outlives the task, so later tasks of the worker start with it; `trim` bounds it."""
    kept = sys.__dict__.setdefault("_driftlane_chunks", {})
    if path not in kept:
        kept[path] = Chunks(path)
    return kept[path]


def cut(n: int, most: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two, large to small, none over most (a power of two)."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if (n % most) >> b & 1]


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids array<int>"


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most GROUP rows and GROUP_BYTES of text, or of one row."""
    size, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)), 0
    while at < batch.num_rows:
        most = int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES, side="right"))
        n = max(1, min(GROUP, most - at))
        yield batch.slice(at, n)
        at += n


def _packer(path: str, digest: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = kept_chunks(path)
        for whole in batches:
            for batch in groups(whole):
                doc, start, length, total, ids, crc = [], [], [], [], [], []
                for doc_id, tokens in zip(batch.column(0).to_pylist(), chunks.encode(pc.fill_null(batch.column(1), "")), strict=True):
                    first = 0
                    for n in cut(len(tokens)):
                        piece = tokens[first : first + n]
                        doc.append(doc_id)
                        start.append(first)
                        length.append(n)
                        total.append(len(tokens))
                        if digest:
                            crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                        else:
                            ids.append(piece)
                        first += n
                if digest:
                    last = pa.array(crc, pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, start, length, total)), last], names=["doc_id", "start", "length", "doc_tokens", "ids_crc32" if digest else "ids"])

    return pack


def pack(documents: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket (log2 of the length).

    With digest, ids_crc32 (over little-endian 32-bit ids) is made in place of
    ids. sequence_id is unique; its numbers have gaps.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = rows.mapInArrow(tidied(_packer(tokenizer_path, digest)), _SCHEMA.replace("ids array<int>", "ids_crc32 long") if digest else _SCHEMA)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet, one folder per bucket of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
