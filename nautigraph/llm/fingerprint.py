"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its top bits are zero.  Chunking is
normalised: up to the target length a stricter mask applies, after it a looser one, so that lengths
gather around the target.  As the hash sees only the last 32 bytes and chunks start anew at every end,
chunk ends line up again soon after an edit.  A fingerprint is the set of digests of a text's chunks,
each with the bytes that it stands for; likeness is the share of bytes in chunks that the other has too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, splitmix

#: Chunk lengths in bytes.  The masks hold on average once in 64 bytes before the target and 16 after it.
SHORTEST, TARGET, LONGEST = 8, 32, 256
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
#: One random 32-bit word per byte value, from a rule.
GEAR = (splitmix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Rows in a partition of the text shuffle, and most partitions; beyond that they get larger.
ROWS, PARTITIONS = 8_000, 20_000
#: Ten bytes a chunk: 48 bits of digest, high part first, and the bytes that it stands for.
_ENTRY = np.dtype([("high", ">u2"), ("low", ">u4"), ("bytes", ">u4")])


def gear_hash(data: bytes) -> np.ndarray:
    """The rolling hash after every byte: the sum of GEAR of the last 32 bytes, each doubled per step since."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 bytes out of two of half the size
        if len(h) > step:
            h = h.copy()
            h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; the last one is len(data)."""
    n = len(data)
    h = gear_hash(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist() + [n]
    loose = loose.tolist() + [n]
    out, start, i, j = [], 0, 0, 0
    while n - start > SHORTEST:
        lo, mid, hi = start + SHORTEST - 1, start + TARGET - 1, start + LONGEST - 1
        while strict[i] < lo:
            i += 1
        if strict[i] < mid:
            end = strict[i] + 1
        else:
            while loose[j] < mid:
                j += 1
            end = min(loose[j], hi) + 1
        if end > n:
            break
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_set(text: str) -> dict[int, int]:
    """Bytes of the text by digest of chunk; a chunk that repeats counts as often as it stands there."""
    data, start, out = text.encode(), 0, {}
    for end in cuts(data):
        d = xxhash.xxh3_64_intdigest(data[start:end]) >> 16
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def pack(chunks: dict[int, int]) -> str:
    """A fingerprint as text: base64 of the sorted digests with their bytes; empty for the empty text."""
    rows = np.array(sorted(chunks.items()), dtype=np.uint64).reshape(-1, 2)
    out = np.empty(len(rows), _ENTRY)
    out["high"], out["low"], out["bytes"] = rows[:, 0] >> np.uint64(32), rows[:, 0] & np.uint64(2**32 - 1), np.minimum(rows[:, 1], np.uint64(2**32 - 1))
    return base64.b64encode(out.tobytes()).decode()


def unpack(fingerprint: str) -> dict[int, int]:
    rows = np.frombuffer(base64.b64decode(fingerprint), _ENTRY)
    return dict(zip(((rows["high"].astype(np.uint64) << np.uint64(32)) | rows["low"]).tolist(), rows["bytes"].tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has as well, each chunk up to its bytes in b.  Empty a: 1 if b is empty, else 0."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of what follows, or all of that if it is shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, part, head: docs dealt out once by ranges of doc_id, sorted within each range.

    Ranges follow quantiles of doc_id, which is all that the first pass reads.  The first row of each range
    also goes to the end of the range before it (head, for the first range: to the end of the last).
    Order is doc_id (null last), then text, so equal ids are a tie that text breaks.
    """
    ids = docs.select("doc_id")
    parts = min(max(1, -(-ids.count() // rows)), PARTITIONS)
    found = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    edges = np.array(sorted({int(e) for e in found}), np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id):  # null ids come last
        return pd.Series(np.where(doc_id.isna(), len(edges), np.searchsorted(edges, doc_id.fillna(0).astype("int64"))), dtype="int32")

    # the id that leads each range, one row per range; ties of that id are sent along and sorted out on arrival
    lead = sorted(ids.select("doc_id", part_of("doc_id").alias("part")).groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    first = {p: f for p, f in lead}
    before = {p: lead[k - 1][0] for k, (p, _) in enumerate(lead)}
    key = dict(zip(first, _dealing_keys(docs.sparkSession, max(1, len(lead)))))

    @F.pandas_udf("array<int>")
    def also(doc_id, part):  # twice a range's key for its rows, one more for the head behind it
        lone = [None if pd.isna(d) else int(d) for d in doc_id]
        return pd.Series([[2 * key[p], 2 * key[before[p]] + 1] if first[p] == d else [2 * key[p]] for d, p in zip(lone, part)])

    keyed = docs.select("doc_id", "text", part_of("doc_id").alias("part"))
    out = keyed.select("doc_id", "text", F.explode(also("doc_id", "part")).alias("to"))
    out = out.select("doc_id", "text", F.shiftright("to", 1).alias("part"), (F.col("to") % 2 == 1).alias("head"))
    out = out.repartition(max(1, len(lead)), "part")
    return out.sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())


def _dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """n different numbers that Spark deals out to n different partitions, so that no task gets two ranges."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = dict(tuple(r) for r in spark.range(32 * n).groupBy(at.alias("p")).agg(F.min("id")).collect())
    spare = iter(range(32 * n, 33 * n))  # a partition that none of them reaches: its range shares another one
    return [int(found[p]) if p in found else next(spare) for p in range(n)]


def with_next(rows: Iterator[tuple]) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, text of the next row) from the rows of in_order(); holds one row back."""
    held = None
    for doc_id, text, part, head in rows:
        text = text or ""
        if held and held[2] == part:
            yield held[0], held[1], text
        held = None if head else (doc_id, text, part)
        # after the first head row nothing of this range is held, so the other ties of it are passed over


def fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    A null text counts as empty, and an empty text has the empty fingerprint, which is like itself (1) and
    nothing else (0).  The next row of the last is the first; a lone row follows itself.  Rows of equal
    doc_id stand in the order of their texts.  An empty table gives no rows.
    """

    def run(batch: Iterator[tuple]) -> Iterator[tuple]:
        last, chunks = None, {}
        for doc_id, text, following in with_next(batch):
            own = chunks if last == text else chunk_set(text)  # the row before had this text as its next
            last, chunks = following, chunk_set(following) if following != text else own
            other = edited(text, following)
            theirs = chunk_set(other)
            digest = hashlib.sha256(other.encode()).hexdigest()
            yield doc_id, len(text), digest, pack(own), pack(theirs), containment(own, theirs), containment(own, chunks)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(in_order(docs, rows), schema, run)


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest, bytes: the fingerprints as rows, for joins on shared chunks."""

    def run(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in batch:
            for d, n in chunk_set(text or "").items():
                yield doc_id, d, n

    return map_rows(docs.select("doc_id", "text"), "doc_id long, digest long, bytes long", run)
