"""Byte-level BPE with DuckDB inside the executors.

A text is split by the tokenizer's pattern. Distinct pieces are encoded by a
recursive query: rows (piece, position, token) join the merge table, and every
step contracts the leftmost pair of the lowest rank of each piece, until no
piece has a pair left. An ordered aggregate turns ids back into bytes.

The recursive query looks at all tokens of a piece in every step, which is quadratic
in its length. Pieces of more than LONG bytes (no blank in so many characters) are
contracted in the same order with a heap of their pairs instead.

The rank file is read where the plan is made and shipped with the task; its size
does not depend on the data.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pieces and chunks whose ids a task keeps for later batches; beyond it the memory is emptied.
KEEP = 500_000
#: Bytes of a piece up to which the recursive query encodes it.
LONG = 256
#: Tokens that one decoding query takes.
DECODE_TOKENS = 1 << 20

#: A step holds the tokens of each piece that is not finished; unnesting gives its token-position rows.
ENCODE = """
WITH RECURSIVE step AS (
    SELECT piece, tokens, true AS live FROM start
  UNION ALL
    (WITH pairs AS (
        SELECT piece, generate_subscripts(tokens, 1) AS pos, (unnest(tokens)::BIGINT << 20) | unnest(tokens[2:]) AS pair
        FROM step WHERE live
     ), best AS (
        SELECT piece, min((merged << 32) | pos) AS best, min((merged << 32) | pos) & 4294967295 AS pos
        FROM pairs JOIN merges USING (pair) GROUP BY piece
     )
     SELECT piece, CASE WHEN best IS NULL THEN tokens ELSE tokens[:pos - 1] || [(best >> 32)::INTEGER] || tokens[pos + 2:] END, best IS NOT NULL
     FROM step LEFT JOIN best USING (piece) WHERE live)
)
SELECT tokens FROM step WHERE NOT live ORDER BY piece
"""

DECODE = "SELECT string_agg(hex, '' ORDER BY pos) FROM tokens JOIN vocabulary USING (id)"

#: White space besides the space itself.
_OTHER_SPACE = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _chunks(text: str) -> list[str]:
    """The text split at its spaces, or whole if a space has white space or an end of the text beside it.

    A single space between other characters is where the pattern splits whatever stands around it.
    """
    if not text or text[0] == " " or text[-1] == " " or "  " in text:
        return [text]
    for c in _OTHER_SPACE:
        if c in text and (c + " " in text or " " + c in text):
            return [text]
    return text.split(" ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, merged) for every way to split a token into two tokens."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, merged = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "merged": pa.array(merged, pa.int64())})


def contract(tokens: list[int], merges: dict[int, int]) -> list[int]:
    """The tokens with the leftmost pair of the lowest rank contracted until none is left, in n log n steps."""
    n = len(tokens)
    at, left, right = list(tokens), list(range(-1, n - 1)), list(range(1, n + 1))
    pair = lambda i: merges.get(at[i] << 20 | at[right[i]]) if i >= 0 and right[i] < n else None
    heap = [(m, i) for i in range(n - 1) if (m := pair(i)) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        m, i = heapq.heappop(heap)
        if gone[i] or pair(i) != m:
            continue
        j = right[i]
        at[i], gone[j], right[i] = m, 1, right[j]
        if right[j] < n:
            left[right[j]] = i
        for k in (left[i], i):
            if (m := pair(k)) is not None:
                heapq.heappush(heap, (m, k))
    return [t for t, x in zip(at, gone, strict=True) if not x]


class Tokenizer:
    """Encoder and decoder of one task; holds a DuckDB database in memory, which never spills to the machine's disk."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.merge_rows = merge_table(ranks)
        self.merges: dict[int, int] = {}
        self.db.register("merge_rows", self.merge_rows)
        self.db.execute("CREATE TABLE merges AS SELECT (a << 20) | b AS pair, merged FROM merge_rows")
        self.db.register("vocabulary_rows", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.pieces: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}  # ids of a chunk at the start of a text
        self.after: dict[str, bytes] = {}  # ids of a space and a chunk

    def _learn(self, pieces: list[str]) -> None:
        """Encodes distinct pieces and remembers their ids, as little-endian 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if max(map(len, raw)) > LONG:
            self.merges = self.merges or {a << 20 | b: m for a, b, m in zip(*(self.merge_rows.column(c).to_pylist() for c in ("a", "b", "merged")), strict=True)}
            for p, x in zip(pieces, raw, strict=True):
                if len(x) > LONG:
                    self.pieces[p] = np.array(contract(self.byte[np.frombuffer(x, np.uint8)].tolist(), self.merges), "<u4").tobytes()
            pieces = [p for p, x in zip(pieces, raw, strict=True) if len(x) <= LONG]
            raw = [x for x in raw if len(x) <= LONG]
            if not raw:
                return
        ends = np.cumsum([len(x) for x in raw], dtype=np.int32)
        tokens = pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), self.byte[np.frombuffer(b"".join(raw), np.uint8)])
        self.db.register("start", pa.table({"piece": np.arange(len(raw), dtype=np.int32), "tokens": tokens}))
        out = self.db.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
        self.db.unregister("start")
        ids = out.flatten().to_numpy().astype("<u4").tobytes()
        at = out.offsets.to_numpy().astype(np.int64) * 4
        self.pieces.update((p, ids[a:b]) for p, a, b in zip(pieces, at.tolist(), at[1:].tolist(), strict=False))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if max(len(self.pieces), len(self.first) + len(self.after)) > KEEP:
            self.pieces.clear(), self.first.clear(), self.after.clear()
        chunks = [_chunks(t or "") for t in texts]
        first = {c[0] for c in chunks} - self.first.keys()
        after = {x for c in chunks for x in c[1:]} - self.after.keys()
        split = [(self.first, c, self.split.findall(c)) for c in first]
        split += [(self.after, c, [" " + c] if c.isascii() and c.isalpha() else self.split.findall(" " + c)) for c in after]
        if new := list({p for _, _, pieces in split for p in pieces} - self.pieces.keys()):
            self._learn(new)
        for into, c, pieces in split:
            into[c] = b"".join([self.pieces[p] for p in pieces])
        after = self.after
        return [np.frombuffer(self.first[c[0]] + b"".join([after[x] for x in c[1:]]), "<u4") for c in chunks]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        out: list[bytes] = []
        at = 0
        while at < len(ids):
            end, n = at, 0
            while end < len(ids) and (end == at or n + len(ids[end]) <= DECODE_TOKENS):
                n += len(ids[end])
                end += 1
            joined = np.concatenate(ids[at:end]).astype(np.int32)
            raw = b""
            if n:
                self.db.register("tokens", pa.table({"pos": np.arange(n, dtype=np.int32), "id": joined}))
                raw = bytes.fromhex(self.db.sql(DECODE).fetchall()[0][0])
                self.db.unregister("tokens")
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size[joined])])
            cut = ends[np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in ids[at:end]])])].tolist()
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            at = end
        return out


class _Task:
    """The tokenizer of a task while it runs, without Python's cycle search: its memory holds a million small objects and no cycles."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.made = lambda: Tokenizer(ranks, pattern)

    def __enter__(self) -> Tokenizer:
        self.was = gc.isenabled()
        gc.disable()
        return self.made()

    def __exit__(self, *_) -> None:
        if self.was:
            gc.enable()


def round_trip(documents: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, and its ids with ``with_ids``.

    Null texts count as empty and have no tokens. Repeated rows come out as
    often as they go in; extra columns are not read. No shuffle.
    """
    common.session(documents)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Task(ranks, pattern) as tokenizer:
            for batch in batches:
                ids = tokenizer.encode(batch.column("text").to_pylist())
                raw = tokenizer.decode(ids)
                columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_column(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids, an array of the token ids of the text.

    Null and empty texts have no ids; repeated rows come out as often as they go in; extra columns are not read.
    """
    common.session(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Task(ranks, pattern) as tokenizer:
            for batch in batches:
                ids = tokenizer.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<long>")


def decode_column(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and raw, the bytes that the ids of (doc_id, ids) stand for; null ids decode to no bytes."""
    common.session(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Task(ranks, pattern) as tokenizer:
            for batch in batches:
                ids = [np.array(x or [], "<u4") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokenizer.decode(ids), pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")
