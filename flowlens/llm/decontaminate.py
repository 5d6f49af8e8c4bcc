"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of an item (the whole item if shorter). Its tokens are its shingles of up to four words.
Containment of a window is exact, so one token is a necessary prefix: the rarest in the order of how often shingles occur
over all documents. Documents are read once: shingles that any window has are kept with the words around them (all other
shingles can't be part of an occurrence), their counts give the order, and the kept rows meet the prefix tokens. The place
of the token in the window and the length of the document bound the place of the window, then its words are compared.

The vocabulary of benchmark shingles is broadcast only after its rows were counted; beyond the limit the same join runs as
a shuffle. The other joins leave the choice to the planner, which splits keys that hold many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch, let, lower_ascii

WINDOW, SHINGLE = 10, 4
#: Most shingle hashes (8 bytes each), or ids of documents to leave out, that are broadcast.
MAX_BROADCAST = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z) text; null has none."""
    def inner(w):
        lead = (F.get(w, F.lit(0)) == "").cast("int")
        trail = (F.get(w, F.size(w) - 1) == "").cast("int")
        return F.slice(w, lead + 1, F.greatest(F.size(w) - lead - trail, F.lit(0)))

    return let(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), inner)


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the runs of k words, by start."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(words, i + j) for j in range(1, k)]))


def windows_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, window, length`` for every window of every item; items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return (items.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.slice("w", F.col("i"), F.lit(WINDOW)).alias("ww"))
            .select("item_id", F.array_join("ww", " ").alias("window"), F.size("ww").alias("length")).distinct())


def _tokens(windows: DataFrame) -> DataFrame:
    """``window, length, token, offset``: every shingle of every distinct window."""
    distinct = windows.select("window", "length").distinct().withColumn("ww", F.split("window", " "))
    tokens = F.when(F.col("length") >= SHINGLE, _shingles(F.col("ww"), SHINGLE))
    for k in range(1, SHINGLE):
        tokens = tokens.when(F.col("length") == k, _shingles(F.col("ww"), k))
    return distinct.select("window", "length", F.posexplode(tokens).alias("offset", "token"))


def _document_tokens(docs: DataFrame, sizes: list[int], vocabulary: DataFrame, sent: bool) -> DataFrame:
    """Shingles of documents that the vocabulary has, with the words around; one row without token per document.

    A vocabulary that is ``sent`` along meets the shingles where the words are. Else only a shingle and the few words around
    it are shuffled, never a text, and the rows of the documents go beside that join.
    """
    w = F.col("w")
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    first = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    found = ["doc_id", "text_hash", "token", "at", F.size(w).alias("n_words"), first.alias("first"),
             F.slice(w, first + 1, F.lit(2 * WINDOW)).alias("around")]
    none = F.struct(F.lit(0).alias("k"), F.array(F.lit(None).cast("long")).alias("tokens"))

    def rolled(arrays: list[Column]) -> DataFrame:
        return (read.select("doc_id", "text_hash", "w", F.inline(F.array(*arrays)))
                .select("doc_id", "text_hash", "w", "k", F.posexplode("tokens").alias("at", "token")))

    arrays = [F.struct(F.lit(k).alias("k"), _shingles(w, k).alias("tokens")) for k in sizes]
    if sent:
        rows = rolled([*arrays, none]).join(vocabulary.withColumn("known", F.lit(True)), "token", "left")
        found[-1] = F.when(F.col("k") > 0, F.slice(w, first + 1, F.lit(2 * WINDOW))).alias("around")
        return rows.where("known or k = 0").select(*found)
    documents = read.select("doc_id", "text_hash", F.lit(None).cast("long").alias("token"), F.lit(None).cast("int").alias("at"),
                            F.size(w).alias("n_words"), F.lit(None).cast("int").alias("first"),
                            F.lit(None).cast("array<string>").alias("around"))
    if not sizes:
        return documents
    return rolled(arrays).select(*found).join(vocabulary, "token").select(documents.columns).unionByName(documents)


def occurrences(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per document, occurrences of windows, windows with their items)."""
    windows = scratch.keep(windows_of(benchmark), "windows")
    tokens = scratch.keep(_tokens(windows), "window-tokens")
    vocabulary = tokens.select("token").distinct()
    sizes = [row.k for row in windows.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    sent = vocabulary.count() <= MAX_BROADCAST
    kept = scratch.keep(_document_tokens(docs, sorted(sizes), F.broadcast(vocabulary) if sent else vocabulary, sent),
                        "document-tokens")
    found = kept.where(F.col("token").isNotNull())
    rarity = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefix = (tokens.join(rarity, "token", "left").groupBy("window", "length")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p"))
              .where("p.n > 0").select("window", "length", F.col("p.token").alias("token"),
                                       F.col("p.offset").alias("offset")))
    start = F.col("at") - F.col("offset")
    hit = (found.join(prefix, "token")
           .where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
           .where(F.array_join(F.slice("around", start - F.col("first") + 1, F.col("length")), " ") == F.col("window"))
           .select("doc_id", "text_hash", "window", start.alias("start"), "length"))
    return kept.where(F.col("token").isNull()).select("doc_id", "text_hash", "n_words"), hit, windows


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, items, contaminated`` per document; items are sorted item ids as text.

    Null or empty texts have no words and no hits; items with a null id mark words and documents but are not listed;
    repeated rows give a row each; an empty benchmark hits nothing. Columns but doc_id, text and item_id are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, hit, windows = occurrences(docs, benchmark, scratch)
    hit = scratch.keep(hit, "occurrences")
    spans = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    named = (hit.select("doc_id", "text_hash", "window").distinct().join(windows.select("window", "item_id"), "window")
             .groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))

    def grow(acc, s):
        stop = s["start"] + s["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), stop - F.greatest(s["start"], acc["end"]))).alias("n"),
                        F.greatest(stop, acc["end"]).alias("end"))

    covered = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), grow,
                          lambda acc: acc["n"])
    hits = spans.select("doc_id", "text_hash", covered.cast("long").alias("n_hit")).alias("s").join(
        named.alias("n"), F.col("s.doc_id").eqNullSafe(F.col("n.doc_id"))
        & (F.col("s.text_hash") == F.col("n.text_hash"))).select("s.*", "n.items")
    r, h = rows.alias("r"), hits.alias("h")
    both = r.join(h, F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.text_hash") == F.col("h.text_hash")),
                  "left")
    none = F.array().cast("array<string>")
    return both.select("r.doc_id", "r.text_hash", F.col("r.n_words").cast("long").alias("n_words"),
                       F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.sort_array(F.coalesce("h.items", none)).alias("items"),
                       (F.coalesce("h.n_hit", F.lit(0)) > 0).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the query."""
    made = contamination(docs.select("doc_id", "text"), benchmark)
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns as they are.

    The ids of those with one are written and counted: up to ``MAX_BROADCAST`` of them are sent to the documents, beyond it
    the planner joins.
    """
    scratch = Scratch(docs.sparkSession)
    bad = scratch.keep(contamination(docs, benchmark, scratch).where("contaminated").select("doc_id", "text_hash").distinct(),
                       "contaminated")
    bad = (F.broadcast(bad) if bad.count() <= MAX_BROADCAST else bad).alias("b")
    d = docs.alias("d")
    return d.join(bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
                  & (F.xxhash64("d.text") == F.col("b.text_hash")), "left_anti")


def sql(table: str = "documents") -> str:
    """The query in DuckDB SQL; ``table`` may be a subquery."""
    def words(column):
        lowered = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce({words('text')}, []) as w from {table}),
i as (select item_id, {words('text')} as w from benchmark),
iw as (select distinct item_id, least({WINDOW}, len(w)) as n, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') as k
       from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) as s from i where len(w) > 0)),
n as (select distinct n from iw),
dw as (select r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as k
       from (select r, w, n.n, unnest(range(1, len(w) - n.n + 2)) as s from d, n where len(w) >= n.n)),
o as (select distinct r, s, dw.n, item_id from dw join iw on dw.k = iw.k and dw.n = iw.n),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from o) group by r),
t as (select r, count(item_id) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
      from (select distinct r, item_id from o) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)"""
