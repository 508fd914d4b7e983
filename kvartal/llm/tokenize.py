"""Problem 7: encoding a corpus with a public byte-level BPE.

A text is cut by the vocabulary's pattern, and each piece is merged on its own. Of a piece, a segment tree
holds the ranks of all adjacent pairs: its root is the leftmost lowest-rank merge, and each merge updates
three leaves, so a piece of n bytes takes O(n log n) whatever its length. Pieces repeat, so every worker
keeps the ids of pieces it has seen, up to a bound. The ranks are broadcast: their number is the
vocabulary's, whatever the corpus.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.names import Memo
from kvartal.session import spread

#: Folder of the public vocabularies; an argument or this variable names another.
FOLDER = os.environ.get("KVARTAL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids, of a .tiktoken vocabulary."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merges of lowest rank first, the leftmost of equals."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[piece]]
    width = 1
    while width < n - 1:
        width *= 2
    # Node value: rank * n + position of the pair's left part; the smallest is leftmost among equal ranks.
    tree = [NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        both = parts[i] + parts[j]
        parts[i], parts[j] = both, None
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            r = get(both + parts[k])
            put(i, NONE if r is None else r * n + i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            r = get(parts[h] + both)
            put(h, NONE if r is None else r * n + h)
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts with one vocabulary; special tokens in a text are ordinary text."""

    _own: dict[int, Encoder] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.find = regex.compile(PATTERN).findall
        self.pieces = Memo(lambda piece: merge(piece.encode(), ranks))

    @classmethod
    def shared(cls, ranks) -> Encoder:
        """One encoder per worker process and broadcast."""
        if ranks.id not in cls._own:
            cls._own.clear()
            cls._own[ranks.id] = cls(ranks.value)
        return cls._own[ranks.id]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.find(text or ""):
            out += pieces[piece]
        return out


class _Broadcast:
    """A broadcast variable with an id that workers can tell apart."""

    def __init__(self, variable, mark: int):
        self.variable, self.id = variable, mark

    @property
    def value(self):
        return self.variable.value


def _broadcast(df: DataFrame, name: str, folder: str) -> _Broadcast:
    ranks = read_ranks(name, folder)
    return _Broadcast(df.sparkSession.sparkContext.broadcast(ranks), hash((name, folder, len(ranks))))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key (bigint) and ids (array of int) of every row, without special tokens.

    NULL and empty texts give the empty list; repeated rows stay repeated; other columns are ignored.
    """
    ranks = _broadcast(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["_key", "_ids"])

    own = spread(df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")), "_key")
    return own.mapInArrow(run, "_key bigint, _ids array<int>").select(F.col("_key").alias(key), F.col("_ids").alias("ids"))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """keep and n_tokens (bigint; 0 for NULL and empty texts) of every row; keep[0] is the key."""
    ranks = _broadcast(df, name, folder)
    own = spread(df.select(*keep, F.col(text).alias("_text")), keep[0])
    schema = own.drop("_text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(ranks)
        for b in batches:
            sizes = [len(encoder.encode(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[f.name for f in schema])

    return own.mapInArrow(run, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text that ids stand for."""
    tokens = {r: t for t, r in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
