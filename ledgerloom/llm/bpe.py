"""Encoding of texts with a public byte-level BPE tokenizer (problem 6).

Every task splits its texts into words and hands the words it has not met yet to
DuckDB: a recursive query joins the token positions of each word with the merge
table and contracts, in each round, the pair of least rank of each word, from the
left at all places where it stands, until no pair can be merged. A merge only
makes pairs of higher rank, so this is contracting the leftmost least pair again
and again. An ordered aggregation reads off the ids of each word.

Defined results: a null and an empty text have the empty list of ids; strings of
special tokens are ordinary text; unpaired surrogates, which UTF-8 can't hold,
don't occur; rows stay as they are, repeated ones included.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.once import spread

TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits a text into words before the merges; a fixed value of the vocabulary.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters of text and bytes of new words that are handled at once, words kept, and bytes of a word that is not kept.
SLICE_CHARS, QUERY_BYTES, KEPT_WORDS, LONG_WORD = 2_000_000, 400_000, 300_000, 256
#: A word of more bytes is contracted round by round, without keeping its earlier rounds.
HUGE_WORD = 20_000

_ROUND = """
  SELECT i + 1 AS i, w, p, CASE WHEN take THEN new ELSE t END AS t
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS eaten
    FROM (
      SELECT *, least AND (row_number() OVER (PARTITION BY w, least, run ORDER BY p)) % 2 = 1 AS take
      FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY w, least ORDER BY p) AS run
        FROM (
          SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS least, row_number() OVER (PARTITION BY w ORDER BY p) AS idx, bool_or(rank IS NOT NULL) OVER (PARTITION BY w) AS open
          FROM (SELECT i, w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt FROM {source}) LEFT JOIN merges ON t = l AND nt = r)
        WHERE open)))
  WHERE NOT eaten"""
_CONTRACT = (
    "WITH RECURSIVE step AS (SELECT 0 AS i, w, p, t FROM seed UNION ALL"
    + _ROUND.format(source="step")
    + ") SELECT w, list(t ORDER BY p) AS ids FROM (SELECT * FROM step QUALIFY i = max(i) OVER (PARTITION BY w)) GROUP BY w"
)


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others from 256 on in their order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """The merge table in DuckDB and the words that a Python worker has met."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = {b: vocab[c] for c, b in _byte_chars().items()}
        self.byte_ids = [ids[b] for b in range(256)]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({
            "l": pa.array([vocab[a] for a, _ in merges], pa.int32()),
            "r": pa.array([vocab[b] for _, b in merges], pa.int32()),
            "rank": pa.array(range(len(merges)), pa.int32()),
            "new": pa.array([vocab[a + b] for a, b in merges], pa.int32()),
        })
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT l, r, min(rank) AS rank, min_by(new, rank) AS new FROM merge_rows GROUP BY l, r")
        self.db.unregister("merge_rows")
        self.known: dict[str, list[int]] = {}

    def _seed(self, words: list[bytes]) -> pa.Table:
        w, p, t = [], [], []
        for i, word in enumerate(words):
            w += [i] * len(word)
            p += range(len(word))
            t += [self.byte_ids[b] for b in word]
        return pa.table({"w": pa.array(w, pa.int32()), "p": pa.array(p, pa.int32()), "t": pa.array(t, pa.int32())})

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        self.db.register("seed", self._seed(words))
        try:
            if len(words) == 1 and len(words[0]) > HUGE_WORD:
                self.db.execute("CREATE OR REPLACE TEMP TABLE cur AS SELECT 0 AS i, w, p, t FROM seed")
                while True:
                    self.db.execute("CREATE OR REPLACE TEMP TABLE nxt AS " + _ROUND.format(source="cur"))
                    if not self.db.execute("SELECT count(*) FROM nxt").fetchall()[0][0]:
                        return [[t for (t,) in self.db.execute("SELECT t FROM cur ORDER BY p").fetchall()]]
                    self.db.execute("DROP TABLE cur; ALTER TABLE nxt RENAME TO cur")
            rows = self.db.execute(_CONTRACT).fetchall()
        finally:
            self.db.unregister("seed")
        out: list[list[int]] = [[] for _ in words]
        for i, ids in rows:
            out[i] = ids
        return out

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of words, some bytes at a time; short ones are kept for later."""
        ids: dict[str, list[int]] = {}
        batch: list[str] = []
        size = 0
        for k, word in enumerate([*words, ""]):
            n = len(word.encode())
            if batch and (k == len(words) or size + n > QUERY_BYTES or n > HUGE_WORD):
                ids.update(zip(batch, self._contract([b.encode() for b in batch]), strict=True))
                batch, size = [], 0
            if word:
                batch.append(word)
                size += n
                if n > HUGE_WORD:
                    ids[word] = self._contract([word.encode()])[0]
                    batch, size = [], 0
        self.known.update((w, i) for w, i in ids.items() if len(w) <= LONG_WORD)
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        # Before the new words are told from the known ones, which this slice needs to the end.
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [WORDS.findall(t) if t else [] for t in texts]
        new = dict.fromkeys(w for words in split for w in words if w not in self.known)
        fresh = self.learn(list(new)) if new else {}
        known = self.known
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w] if w in known else fresh[w]
            out.append(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row: a pure map, so the ids follow the order and size of the input."""
    path = os.path.join(folder, f"{tokenizer}.json")
    key_type = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                taken, chars = [], 0
                while at + len(taken) < batch.num_rows and (not taken or chars < SLICE_CHARS):
                    value = texts[at + len(taken)].as_py()
                    taken.append(value)
                    chars += len(value or "")
                ids = pa.array(enc.encode(taken), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(taken)), ids], names=[key, "ids"])
                at += len(taken)

    return spread(documents.select(key, text)).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` and ``tokens``, the number of ids of each text, counted with the rank file of the same vocabulary."""
    path = os.path.join(folder, f"{tokenizer}.tiktoken")

    def counter():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        return tiktoken.Encoding(tokenizer, pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.setdefault(path, None) or counter()
        _ENCODERS[path] = enc
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    df = documents.select(*keep, text)
    return spread(df).mapInArrow(run, T.StructType([*df.schema.fields[: len(keep)], T.StructField("tokens", T.LongType())]))


def decoded_bytes(spark: SparkSession, encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_bytes): the bytes that the ids stand for, by joining the exploded ids with the vocabulary."""
    chars = _byte_chars()
    vocab = json.load(open(os.path.join(folder, f"{tokenizer}.json"), encoding="utf-8"))["model"]["vocab"]
    sizes = spark.createDataFrame([(i, len(t)) for t, i in vocab.items() if all(c in chars for c in t)], "id int, n_bytes int")
    key = encoded.columns[0]
    ids = encoded.select(key, F.explode("ids").alias("id")).groupBy(key, "id").agg(F.count("*").alias("n"))
    return ids.join(F.broadcast(sizes), "id").groupBy(key).agg(F.sum(F.col("n") * F.col("n_bytes")).alias("n_bytes"))
