"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Each Spark partition splits its texts into words, and encodes the words it has not met yet with a recursive DuckDB
query: token-position rows join the merge table, and each word's leftmost minimum-rank pair is contracted until no
pair is left; an ordered aggregation gives the word's ids. Nothing is shuffled and no vocabulary leaves its task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are contracted by rounds that keep one state only, all occurrences of the best pair at once.
LONG_WORD = 256
#: A task forgets its words beyond so many; texts are worked through in blocks of so many characters.
WORDS_KEPT, BLOCK_CHARS = 400_000, 4_000_000

SHORT_WORDS = """
WITH RECURSIVE step AS (
 SELECT w, pos, tok, 0 AS i FROM letters
 UNION ALL (
  WITH pairs AS (SELECT *, lead(tok) OVER o AS after, lag(pos) OVER o AS before FROM step WINDOW o AS (PARTITION BY w ORDER BY pos)),
  ranked AS (SELECT pairs.*, merged FROM pairs LEFT JOIN merges ON tok = l AND after = r),
  best AS (SELECT w, min(merged * 4294967296 + pos) AS b FROM ranked WHERE merged IS NOT NULL GROUP BY w)
  SELECT w, pos, CASE WHEN pos = b % 4294967296 THEN b // 4294967296 ELSE tok END, i + 1
  FROM ranked JOIN best USING (w) WHERE before IS NULL OR before <> b % 4294967296)),
ends AS (SELECT w, max(i) AS i FROM step GROUP BY w)
SELECT w, list(tok ORDER BY pos) AS ids FROM step JOIN ends USING (w, i) GROUP BY w ORDER BY w"""

LONG_ROUND = """
CREATE OR REPLACE TEMP TABLE next_state AS
WITH pairs AS (SELECT *, lead(tok) OVER o AS after FROM state WINDOW o AS (PARTITION BY w ORDER BY pos)),
ranked AS (SELECT pairs.*, merged FROM pairs LEFT JOIN merges ON tok = l AND after = r),
best AS (SELECT *, merged IS NOT NULL AND merged = min(merged) OVER (PARTITION BY w) AS hit, row_number() OVER (PARTITION BY w ORDER BY pos) AS k FROM ranked),
runs AS (SELECT *, k - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS in_run FROM best),
taken AS (SELECT *, hit AND in_run % 2 = 1 AS take FROM runs),
marked AS (SELECT *, lag(take) OVER (PARTITION BY w ORDER BY pos) AS gone FROM taken)
SELECT w, pos, CASE WHEN take THEN merged ELSE tok END AS tok FROM marked WHERE NOT coalesce(gone, false)"""


class Encoder:
    """Word ids of one task: words met so far, their ids end to end, and a DuckDB connection with the merge table."""

    def __init__(self, vocabulary: str):
        letters, merges = _vocabulary(vocabulary)
        self.letters = letters
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.con.register("merge_rows", merges)
        self.con.execute("CREATE TABLE merges AS SELECT l::BIGINT AS l, r::BIGINT AS r, merged::BIGINT AS merged FROM merge_rows")
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        first = np.repeat(np.cumsum(size) - size, size)
        tok = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table({"w": np.repeat(np.arange(len(words)), size), "pos": np.arange(len(tok)) - first, "tok": tok})
        self.con.register("letters", rows)
        if size.max() <= LONG_WORD:
            out = self.con.sql(SHORT_WORDS).to_arrow_table()
        else:
            self.con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM letters")
            count, left = -1, len(tok)
            while count != left:
                count = left
                self.con.execute(LONG_ROUND)
                self.con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM next_state")
                left = self.con.execute("SELECT count(*) FROM state").fetchall()[0][0]
            out = self.con.sql("SELECT w, list(tok ORDER BY pos) AS ids FROM state GROUP BY w ORDER BY w").to_arrow_table()
        self.con.unregister("letters")
        ids = out["ids"].combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0)
        return ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())

    def learn(self, words: list[str]) -> None:
        """Encode words not met before; they already have their numbers in ``known``."""
        raw = [w.encode("utf-8", "replace") for w in words]
        where = {True: [i for i, w in enumerate(raw) if len(w) > LONG_WORD], False: [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]}
        length, at = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        flats, base = [self.flat], len(self.flat)
        for group in where.values():
            if group:
                ids, sizes = self._query([raw[i] for i in group])
                length[group], at[group] = sizes, base + np.cumsum(sizes) - sizes
                base += len(ids)
                flats.append(ids)
        self.flat = np.concatenate(flats)
        self.start, self.length = np.concatenate([self.start, at]), np.concatenate([self.length, length])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and each text's number of words."""
        known, new, numbers, sizes = self.known, [], [], []
        for text in texts:
            found = self.pattern.findall(text) if text else []
            sizes.append(len(found))
            for w in found:
                n = known.get(w)
                if n is None:
                    n = known[w] = len(known)
                    new.append(w)
                numbers.append(n)
        if new:
            self.learn(new)
        return np.array(numbers, np.int64), np.array(sizes, np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        numbers, sizes = self.words(texts)
        total = np.concatenate([[0], np.cumsum(self.length[numbers])])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        numbers, sizes = self.words(texts)
        length = self.length[numbers]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(self.start[numbers] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _sent(docs: DataFrame, vocabulary: str) -> Callable[[], str]:
    """Sends the driver's vocabulary file to every executor; its path there."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    return lambda: SparkFiles.get(name)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, pa.Table]:
    """Ids of the 256 bytes, and a row for every pair of tokens that make up a third one."""
    ranks = _ranks(path)
    pairs = [(ranks[t[:k]], ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    columns = np.array(pairs, np.int64).T
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64), pa.table(dict(zip(("l", "r", "merged"), columns, strict=True)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        begin, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars > BLOCK_CHARS:
                yield keys.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, chars = i + 1, 0
        yield keys.slice(begin), texts[begin:]


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """(key, ids): token ids of each text, without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list. Every row is encoded, repeated ones too; texts of any length are encoded
    whole; other columns are ignored. A surrogate that UTF-8 can't hold is encoded as a question mark.
    """
    at = _sent(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(at())
        for keys, texts in _blocks(batches):
            if len(encoder.known) > WORDS_KEPT:
                encoder.forget()
            yield pa.RecordBatch.from_arrays([keys, encoder.encode(texts)], names=[key, ids])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(work, f"`{key}` {kind}, `{ids}` array<bigint>")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", count: str = "n_tokens") -> DataFrame:
    """(key, count): number of tokens of each text; 0 for null and empty texts."""
    at = _sent(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(at())
        for keys, texts in _blocks(batches):
            if len(encoder.known) > WORDS_KEPT:
                encoder.forget()
            yield pa.RecordBatch.from_arrays([keys, pa.array(encoder.counts(texts), pa.int64())], names=[key, count])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(work, f"`{key}` {kind}, `{count}` bigint")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """(key, text): the text of each list of token ids, an ordered aggregation of the tokens' bytes within its row.

    An empty list gives an empty text, a null list null. Bytes that are no UTF-8, as where a list ends within a character,
    become U+FFFD; an id outside the vocabulary, or null, fails. Other columns are ignored.
    """
    at = _sent(encoded, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in _ranks(at()).items()}
        for batch in batches:
            texts = [None if row is None else b"".join([token[i] for i in row]).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, text])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, F.col(ids).cast("array<bigint>")).mapInArrow(work, f"`{key}` {kind}, `{text}` string")
