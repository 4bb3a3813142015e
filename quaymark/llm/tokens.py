"""Encoding a corpus with a public byte-level BPE vocabulary, by longest matches and compatible neighbours."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct pieces whose encoding one worker keeps; a full memo is emptied, which costs time and changes nothing.
MEMO_PIECES = 400_000
#: Pairs of neighbours remembered by a worker before it starts anew.
MEMO_PAIRS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary file with one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(number) for token, number in map(bytes.split, f)}


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> tuple[bytes, str]:
    """The bytes of a vocabulary file and the pattern that cuts a text into pieces. `folder` holds the file; by default it
    is where the package public_tokenizers lies."""
    import public_tokenizers

    with open(f"{folder}/{name}" if folder else public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


class Encoder:
    """Exact BPE in linear time.

    Bytes are read as Latin-1 characters, so that an automaton over characters finds all tokens that start at each byte.
    A sequence of tokens is the one that merging gives exactly if each two neighbours are compatible: merging their
    joint bytes gives these two tokens again. So the longest match is taken if it is compatible with the token before;
    else shorter ones, and where none is left the step before is taken back and its place never tried again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut = {token.decode("latin-1"): number for token, number in ranks.items()}, regex.compile(pattern)
        self.text = {number: token for token, number in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.ranks.items():
            self.automaton.add_word(token, (number, len(token)))
        self.automaton.make_automaton()
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, lowest id first: only for the bytes of two neighbours, and as what tests compare with."""
        parts = list(text)
        while len(parts) > 1:
            number, i = min((self.ranks.get(parts[j] + parts[j + 1], 1 << 60), j) for j in range(len(parts) - 1))
            if number == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.neighbours.get(pair)
        if known is None:
            if len(self.neighbours) >= MEMO_PAIRS:  # a worker's memory stays bounded
                self.neighbours.clear()
            a, b = self.text[left], self.text[right]
            known = self.neighbours[pair] = self.merged(a + b) == [a, b]
        return known

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece, given as Latin-1."""
        if text in self.ranks:
            return [self.ranks[text]]
        size = len(text)
        options: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (number, length) in self.automaton.iter(text):
            options[end + 1 - length].append((length, number))
        for found in options:
            found.sort()
        open_from = [True] * (size + 1)
        path: list[tuple[int, int]] = []
        at = 0
        while at < size:
            found, step = options[at], None
            while found:
                length, number = found[-1]
                if open_from[at + length] and (not path or self.compatible(path[-1][1], number)):
                    step = (length, number)
                    break
                found.pop()
            if step is None:
                open_from[at] = False
                at -= path.pop()[0]
                options[at].pop()
            else:
                path.append(step)
                at += step[0]
        return [number for _, number in path]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.cut.findall(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                ids = memo[piece] = self.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
            out.append(ids)
        return list(chain.from_iterable(out))


@lru_cache(2)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder({base64.b64decode(token): int(number) for token, number in (line.split() for line in raw.splitlines())}, pattern)


def encode_corpus(df: DataFrame, text: str = "text", ids: str = "ids", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, lengths_only: bool = False) -> DataFrame:
    """`df` without `text` and with the column `ids`: array<int>, or the number of tokens with `lengths_only`.

    No special tokens: where a text spells one, that is ordinary text. Empty and null texts give an empty list (0). A
    column of the name `ids` is replaced; other columns pass unchanged. No shuffle: each Arrow batch is encoded where
    it lies. The vocabulary (under 1 MB, a fixed file) is read by the driver and sent along.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary(name, folder))
    kept = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(ids, T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            rows = [encoder.encode(x) for x in batch.column(text).to_pylist()]
            sizes = np.fromiter(map(len, rows), np.int32, len(rows))
            if lengths_only:
                made = pa.array(sizes)
            else:
                flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, ids])

    return df.mapInArrow(run, schema)
