"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits in five segments on a ring. If two differ in at most four bits, the pigeonring principle gives a
segment from which every chain of l consecutive segments differs in at most floor(4 l / 5) bits: 0, 1, 2, 3, 4. The first
three budgets become the join key: the first segment must be equal; with at most one difference in the second, one of its
two halves is equal; with at most two in the third, one of its three thirds is equal. So a fingerprint has 5 x 2 x 3 keys
of 22 to 27 bits, two linked fingerprints share a key, and candidates pass the whole chain before the full Hamming check.

Only connectivity is wanted, so a dense group never becomes all its pairs. Equal fingerprints are one row from the start.
Within a key, members near its most frequent fingerprint link to that alone (a star); after components of the stars are
known, only keys that still hold different components are joined, and only across components. No link is lost: every pair
that shares a key either has one component already or is compared.

Tables of keys are never broadcast: Spark sizes them by the table they are exploded from, or by their files, in which the
repeated fingerprints take a few bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import Scratch, unused
from flowlens.llm.components import connected_components

SHINGLE, SEED, BITS, MAX_DISTANCE = 4, 42, 64, 4
#: Shingles per block of the bit count, which holds 64 bytes each.
BLOCK = 65_536
#: Characters per step over one text; a longer text is taken in steps.
STEP = 4_000_000


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of one text: bit j is set if it is set in over half of the shingle hashes."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    n = max(1, len(starts) - SHINGLE + 1)
    ends = np.append(starts[SHINGLE:] - 1, len(data)) if len(starts) >= SHINGLE else np.array([len(data)])
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(),
                                                                  ends[at : at + BLOCK].tolist())], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        made = np.fromiter((fingerprint(t) for t in texts.fillna("")), np.uint64, len(texts))
        yield pd.Series(made.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with ``fp``, the fingerprint as a signed long; null text has no words and gets 0."""
    rest = [name for name in docs.columns if name not in (text, "fp")]
    return docs.select(*rest, _fingerprints(F.col(text)).alias("fp"))


def _cuts(width: int, parts: int) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


SEGMENTS = MAX_DISTANCE + 1
_BOUNDS = _cuts(BITS, SEGMENTS)


def _bits(fp: Column, start: int, stop: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << (stop - start)) - 1))


def chain_keys(fp: Column) -> Column:
    """The 30 keys of a fingerprint: start segment, a half of the next, a third of the one after."""
    keys = []
    for i in range(SEGMENTS):
        first, second, third = ((_BOUNDS[(i + j) % SEGMENTS], _BOUNDS[(i + j) % SEGMENTS + 1]) for j in range(3))
        head = _bits(fp, *first)
        halves, thirds = ([(span[0] + c, span[0] + d) for c, d in zip(_cuts(span[1] - span[0], parts),
                                                                     _cuts(span[1] - span[0], parts)[1:])]
                          for span, parts in ((second, 2), (third, 3)))
        for half in halves:
            for part in thirds:
                tail = F.shiftleft(_bits(fp, *half), part[1] - part[0]).bitwiseOR(_bits(fp, *part))
                width = half[1] - half[0] + part[1] - part[0]
                value = F.shiftleft(head, width).bitwiseOR(tail)
                keys.append(value.bitwiseOR(F.lit(len(keys) << 40)))
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def passes_chain(a: Column, b: Column) -> Column:
    """True if some start segment keeps every chain of l segments within floor(l * MAX_DISTANCE / SEGMENTS) bits."""
    x = a.bitwiseXOR(b)
    starts = []
    for i in range(SEGMENTS):
        mask, fits = 0, []
        for j in range(SEGMENTS - 1):
            k = (i + j) % SEGMENTS
            mask |= ((1 << (_BOUNDS[k + 1] - _BOUNDS[k])) - 1) << _BOUNDS[k]
            signed = mask - (1 << 64) if mask >> 63 else mask
            fits.append(F.bit_count(x.bitwiseAND(F.lit(signed))) <= (j + 1) * MAX_DISTANCE // SEGMENTS)
        starts.append(fits)
    whole = None
    for fits in starts:
        chain = fits[0]
        for fit in fits[1:]:
            chain = chain & fit
        whole = chain if whole is None else whole | chain
    return whole


def linked(a: Column, b: Column) -> Column:
    return passes_chain(a, b) & (distance(a, b) <= MAX_DISTANCE)


def link_fingerprints(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, root`` for the fingerprints of ``counted(fp, n)`` that link to another; root names the component."""
    keyed = counted.select("fp", "n", F.explode(chain_keys(F.col("fp"))).alias("key"))
    hubs = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"),
                                     F.max(F.struct("n", "fp")).alias("hub")).where("members > 1")
            .select("key", F.col("hub.fp").alias("hub")))
    shared = scratch.keep(keyed.select("key", "fp").join(hubs.hint("merge"), "key"), "shared-keys")
    own = Scratch(scratch.spark)
    stars = shared.where((F.col("fp") != F.col("hub")) & linked(F.col("fp"), F.col("hub")))
    first = own.keep(connected_components(stars.select(F.col("fp").alias("a"), F.col("hub").alias("b")), own), "stars")
    left = first.select(F.col("node").alias("fp"), "component")
    member = (shared.join(left.hint("merge"), "fp", "left")
              .select("key", "fp", F.coalesce("component", "fp").alias("c")))
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_keys = own.keep(member.join(mixed.hint("merge"), "key", "left_semi"), "open-keys")
    x, y = open_keys.alias("x"), open_keys.alias("y")
    across = (x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c"))
                     & linked(F.col("x.fp"), F.col("y.fp")))
              .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct())
    second = connected_components(across, own)
    merged = second.select(F.col("node").alias("component"), F.col("component").alias("root"))
    nodes = first.join(merged, "component", "left").select(
        F.col("node").alias("fp"), F.coalesce("root", "component").alias("root"))
    alone = merged.join(first.select("component"), "component", "left_anti").select(F.col("component").alias("fp"), "root")
    done = scratch.keep(nodes.unionByName(alone), "linked")
    own.drop()
    return done


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` per document; component_id is the least doc_id reachable over links.

    Two documents link if their fingerprints differ in at most four bits. A null id keeps its row and never becomes a
    component's id unless the component has no other (then it is null). Repeated rows and ties are linked like any rows;
    documents without words share fingerprint zero; an empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))),
                          "fingerprints")
    return components_of(marked, scratch)


def components_of(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """``marked(doc_id, fp, ...)`` with ``component_id`` and ``root``, a fingerprint that names the component."""
    counted = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    counted = scratch.keep(counted, "distinct-fingerprints")
    roots = link_fingerprints(counted.select("fp", "n"), scratch)
    rooted = counted.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id", "root")
    return marked.join(known, "fp")


def keep_one(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the least doc_id, among equal ids the least text hash.

    A null id goes last. Rows with the same id and text count once, whatever their other columns. Only ids and hashes are
    grouped; the texts move once, to meet the kept ids.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    key = F.xxhash64(text)
    marked = scratch.keep(fingerprints(docs.select("doc_id", key.alias("text_hash"), F.col(text).alias("text"))),
                          "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    rows = components_of(marked, scratch).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), order).alias("k")).select("k.*")
    kept = scratch.keep(kept, "kept")

    def among(ids):
        d, k = docs.alias("d"), ids.alias("k")
        return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(f"d.{text}") == F.col("k.text_hash")),
                      "left_semi")

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return among(kept)
    names, own = docs.columns, unused(docs, "__key")
    once = (among(repeated).withColumn(own, F.xxhash64(text)).dropDuplicates(["doc_id", own]).select(*names))
    return among(kept.where("n = 1")).unionByName(once)


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, fingerprint, component_id."""
    made = near_duplicates(docs)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
