"""Byte-level BPE as relational work in DuckDB, inside each partition.

Encoding: the pre-tokens of a slice are made distinct; their bytes become rows
(word, place, token), and a recursive query joins neighbouring rows with the merge table
and contracts each word's leftmost pair of minimum rank until none is left. A word of
more than LONG_WORD bytes is contracted step by step in a table of its own size instead,
all places of the minimum pair at once where the vocabulary allows it, as the recursive
query would keep every step of it. Decoding: ids join the vocabulary and an ordered
aggregate puts the bytes together.

Defined cases: a null text counts as empty and has no ids; equal texts get equal ids; long
texts are encoded whole. Extra columns pass through, ``ids`` and ``decoded`` replace
columns of these names. DuckDB runs in the Python worker, in memory, with one thread.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as X

LONG_WORD = 256  # bytes
CACHED_WORDS = 250_000  # each of two generations of known words
SLICE_BYTES = 1 << 20
KEPT_ROWS = 1 << 24  # rows that one recursive query may keep: half the sum of the words' squared bytes at most
MAX_TOKEN_BYTES = 255  # the packed key below has 8 bits for a length

# key: rank (17 bits) | place (30) | length of the left (8) and right token (8)
_PLACE, _RANK = 16, 46
_BEST_PLACE = f"((best >> {_PLACE}) & {(1 << 30) - 1})"
_ENCODE = f"""
WITH RECURSIVE state AS (
    SELECT 0 AS step, word, place, token, size FROM bytes_of_words
    UNION ALL
    (WITH best AS MATERIALIZED (
        SELECT a.word, min((m.rank << {_RANK}) | (a.place << {_PLACE}) | (a.size << 8) | b.size) AS best
        FROM state a JOIN state b ON b.place = a.place + a.size
        JOIN merges m ON m.pair = a.token * 65536::BIGINT + b.token
        GROUP BY a.word)
     SELECT step + 1, word, place,
            CASE WHEN place = {_BEST_PLACE} THEN (best >> {_RANK})::INTEGER ELSE token END,
            CASE WHEN place = {_BEST_PLACE} THEN size + (best & 255)::INTEGER ELSE size END
     FROM state JOIN best USING (word)
     WHERE place <> {_BEST_PLACE} + ((best >> 8) & 255)))
SELECT word, place, token
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY place
"""
_LONG_BEST = """
CREATE OR REPLACE TEMP TABLE pairs AS
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS k FROM long_state),
found AS (
    SELECT a.word, a.place, a.k, b.place AS right_place, b.size AS right_size, m.rank, m.alone
    FROM numbered a JOIN numbered b ON b.place = a.place + a.size
    JOIN merges m ON m.pair = a.token * 65536::BIGINT + b.token),
least AS (
    SELECT * FROM found JOIN (SELECT word, min(rank) AS rank FROM found GROUP BY word) USING (word, rank)),
runs AS (
    SELECT *, k - row_number() OVER (PARTITION BY word ORDER BY place) AS run FROM least)
SELECT word, place, right_place, right_size, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY place) AS nth,
           row_number() OVER (PARTITION BY word ORDER BY place) AS first FROM runs)
WHERE CASE WHEN alone THEN first = 1 ELSE nth % 2 = 1 END
"""
_LONG_STEP = """
CREATE OR REPLACE TEMP TABLE long_state AS
SELECT s.word, s.place, coalesce(l.rank, s.token)::INTEGER AS token, (s.size + coalesce(l.right_size, 0))::INTEGER AS size
FROM long_state s LEFT JOIN pairs l ON l.place = s.place
WHERE s.place NOT IN (SELECT right_place FROM pairs)
"""


class BytePairs:
    """The vocabulary and merges of a rank file, in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(map(len, self.ranks)) > MAX_TOKEN_BYTES or max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ranks of 16 bits and tokens of 255 bytes at most")
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"temp_directory": ""})  # nothing is spilled into the worker's folder
        self.db.execute("SET threads = 1")
        pairs = [(a * 65536 + b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                 if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        # a token whose growth by a neighbour can have a lower rank than itself: its places
        # must be contracted one by one
        alone = {part_rank for token, rank in self.ranks.items() for i in range(1, len(token))
                 for part in (token[:i], token[i:]) if (part_rank := self.ranks.get(part, -1)) > rank}
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()),
                    rank=pa.array([r for _, r in pairs], pa.int64()), alone=pa.array([r in alone for _, r in pairs], pa.bool_()))
        # bytes as the characters of the same number, so that DuckDB joins them as text
        self._table("vocabulary", token=pa.array(list(self.ranks.values()), pa.int32()),
                    piece=pa.array([t.decode("latin-1") for t in self.ranks], pa.string()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, words: list[bytes]) -> pa.Table:
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        return pa.table({"word": word, "place": np.arange(len(data)) + word, "token": self.byte[data],
                         "size": np.ones(len(data), np.int32)})  # a gap in place between words

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as little-endian 32-bit integers."""
        self.db.register("bytes_of_words", self._rows(words))
        found = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("bytes_of_words")
        return self._by_word(found, len(words))

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        self.db.register("given", self._rows(words))
        self.db.execute("CREATE OR REPLACE TEMP TABLE long_state AS SELECT * FROM given")
        self.db.unregister("given")
        while True:
            self.db.execute(_LONG_BEST)
            if not self.db.execute("SELECT count(*) FROM pairs").fetchall()[0][0]:
                break
            self.db.execute(_LONG_STEP)
        return self._by_word(self.db.sql("SELECT word, place, token FROM long_state ORDER BY place").to_arrow_table(), len(words))

    @staticmethod
    def _by_word(rows: pa.Table, n: int) -> list[bytes]:
        ids = rows.column("token").to_numpy().astype("<u4").tobytes()
        at = (np.searchsorted(rows.column("word").to_numpy(), np.arange(n + 1)) * 4).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of all these words; what is known already is not encoded again."""
        found: dict[str, bytes] = {}
        new: list[str] = []
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                ids = self.older.get(w)
                if ids is None:
                    rank = self.ranks.get(w.encode())
                    if rank is None:
                        new.append(w)
                        continue
                    ids = rank.to_bytes(4, "little")
                self.known[w] = ids
            found[w] = ids
        short = [w for w in new if len(w) <= LONG_WORD // 4]
        long = [w for w in new if len(w) > LONG_WORD // 4]
        if short:
            coded = [w.encode() for w in short]
            kept = np.cumsum([len(w) ** 2 // 2 for w in coded])
            i = 0
            while i < len(short):  # each call takes what it may keep, one word at least
                j = max(i + 1, int(np.searchsorted(kept, (kept[i - 1] if i else 0) + KEPT_ROWS, side="right")))
                found.update(zip(short[i:j], self._contract(coded[i:j])))
                i = j
        if long:
            found.update(zip(long, self._contract_long([w.encode() for w in long])))
        self.known.update((w, found[w]) for w in short)
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as little-endian 32-bit integers."""
        parts = [self.split(t) if t else [] for t in texts]
        ids = self.learn({w for part in parts for w in part})
        return [b"".join(map(ids.__getitem__, part)) for part in parts]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        self.db.register("ids", pa.table({"text": np.repeat(np.arange(len(ids)), sizes),
                                          "place": np.arange(len(flat)), "token": flat}))
        rows = self.db.sql("SELECT text, string_agg(piece, '' ORDER BY place) AS decoded "
                           "FROM ids JOIN vocabulary USING (token) GROUP BY text").fetchall()
        self.db.unregister("ids")
        found = dict(rows)
        return [found.get(i, "").encode("latin-1") for i in range(len(ids))]


_loaded: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One for each file and Python worker."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = BytePairs(path, pattern)
    return _loaded[key]


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = False, column: str = "text") -> DataFrame:
    """Adds `ids` (little-endian 32-bit integers) of each whole text, and with `decode`
    the bytes decoded from them."""
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()),
                           *([T.StructField("decoded", T.BinaryType())] if decode else [])])

    def run(batches):
        coder = byte_pairs(path, pattern)
        for part in X.slices(batches, column, SLICE_BYTES):
            ids = coder.encode(part.column(part.schema.get_field_index(column)).to_pylist())
            extra = [pa.array(ids, pa.binary())]
            if decode:
                extra.append(pa.array(coder.decode(ids), pa.binary()))
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=schema.names)

    return docs.mapInArrow(run, schema)
