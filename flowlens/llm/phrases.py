"""Phrase collocations from mergeable Misra-Gries summaries, one per hash partition, and an exact second pass.

Texts are packed into chunks of one language, words and pieces in a canonical form. Pass one hashes every phrase of 1 to 4
words; a chunk sends each hash partition its distinct hashes and counts. A partition of mass M (phrase occurrences) merges
them in a summary of more than M / threshold counters: merging takes at most M / (counters + 1) < threshold off any phrase,
so whatever occurs often enough is still there, and memory does not grow with the distinct phrases. The surviving hashes are
counted over the same blocks, and each chunk is told which of its own hashes are frequent (a semi-join by reply: nothing is
broadcast). Pass two counts those phrases in the texts by their bytes; hashes only choose what is counted.

Cuts, scores and containment are joins over the table of frequent phrases. A chunk and a partition have a bounded size
whatever the input: ``CHUNK`` bytes of text (a longer piece without any separator stays whole) and ``PART`` bytes of text
per partition. A common phrase is one entry per chunk.

Null and empty texts have no words; a null language is ``und``. Repeated rows count again. Texts and languages are compared
by their bytes. An empty table gives no rows. Columns but text and lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch

LONGEST, THRESHOLD, CONTAINED_PERCENT, TOP, UNIT = 4, 30, 80, 2000, 1_000_000
#: Bytes of text in a chunk; bytes that may wait in a task for their chunk; bytes of text per hash partition.
CHUNK, WAITING, PART = 2_500_000, 12_000_000, 12_000_000
#: Bits of a hash beyond the logarithm of the input's bytes that blocks keep.
SPARE_BITS = 9
_SPACE, _END = 0x20, 0x0A
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _SPACE if c == 9 else _END if chr(c) in ".,;:!?\n\x0b\x0c\r" else c
               for c in range(256))


def canonical(text: bytes) -> bytes:
    """Lower-cased words, one space between words of a piece and one line feed between pieces."""
    raw = np.frombuffer(text.translate(_TABLE), np.uint8)
    end = raw == _END
    gap = end | (raw == _SPACE)
    lead = gap.copy()
    lead[1:] &= ~gap[:-1]  # the first byte of every run of separators stands for the run
    first = np.flatnonzero(lead)
    ends = np.concatenate(([0], np.cumsum(end)))
    change = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stop = np.concatenate((change, [len(raw)]))[: len(first)]
    kept = ~gap | lead
    made = raw[kept]
    made[np.cumsum(kept)[first] - 1] = np.where(ends[stop] > ends[first], _END, _SPACE)
    return made.tobytes().strip(b" \n")


class Words:
    """Words of a canonical text: where they start and end, their hashes and the piece they lie in."""

    def __init__(self, text: bytes, seed: int):
        self.text = text
        raw = np.frombuffer(text + b"\n" * 8, np.uint8)
        gaps = np.flatnonzero((raw[: len(text)] == _SPACE) | (raw[: len(text)] == _END)) if text else np.zeros(0, np.int64)
        self.start = np.concatenate(([0], gaps + 1)) if text else gaps
        self.end = np.concatenate((gaps, [len(text)])) if text else gaps
        self.piece = np.concatenate(([0], np.cumsum(raw[gaps] == _END))) if text else gaps
        self.load = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
        self.hash = self._hashes(seed)

    def _hashes(self, seed: int) -> np.ndarray:
        size = self.end - self.start
        made = np.full(len(size), seed, np.uint64) ^ size.astype(np.uint64)
        which, at = np.arange(len(size)), 0
        while len(which):
            made[which] = _mix(made[which] ^ self._eight(self.start[which] + at, size[which] - at))
            at += 8
            which = which[size[which] > at]
        return made

    def _eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to 8 bytes from each place as one number; bytes beyond ``left`` are zero."""
        return self.load[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 1 .. longest: n, the first words of all phrases of n words, their hashes."""
        at, made = np.arange(len(self.start)), self.hash
        for n in range(1, longest + 1):
            yield n, at, made
            keep = at + n < len(self.start)
            keep[keep] = self.piece[at[keep] + n] == self.piece[at[keep]]
            at = at[keep]
            made = _mix(made[keep] * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + n])

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the phrases of n words from words a and from words b are the same bytes."""
        size = self.end[a + n - 1] - self.start[a]
        equal = size == self.end[b + n - 1] - self.start[b]
        which, at = np.flatnonzero(equal), 0
        while len(which):
            x, y, left = self.start[a[which]] + at, self.start[b[which]] + at, size[which] - at
            differ = self._eight(x, left) != self._eight(y, left)
            equal[which[differ]] = False
            at += 8
            which = which[~differ & (left > 8)]
        return equal


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; the first byte tells how many."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _expand(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    made = np.zeros((n, 8), np.uint8)
    made[:, :width] = planes.T
    return made.view("<u8").reshape(-1)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_expand(data, n), dtype=np.uint64)


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (1 each without counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


class MisraGries:
    """A mergeable summary of so many counters: no count falls by more than mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.keys, self.counts = capacity, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds the counters of another summary, or exact counts of a part."""
        keys, counts = _tally(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        if len(keys) > self.capacity:
            counts = counts - np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def _chunks(rows: DataFrame) -> DataFrame:
    """``chunk, lang, n_words, text`` from ``lang, text``."""
    def run(batches):
        base, number, waiting, held = TaskContext.get().partitionId() << 32, 0, {}, 0

        def flush(lang):
            nonlocal number, held
            text = b"\n".join(waiting.pop(lang))
            held -= len(text)
            number += 1
            words = text.count(b" ") + text.count(b"\n") + 1
            return pa.RecordBatch.from_pydict({"chunk": pa.array([base + number - 1], pa.int64()), "lang": [lang],
                                               "n_words": pa.array([words], pa.int64()), "text": pa.array([text], pa.binary())})

        sizes: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                for part in _parts(text.as_py()):
                    made = canonical(part)
                    if not made:
                        continue
                    waiting.setdefault(lang, []).append(made)
                    sizes[lang] += len(made) + 1
                    held += len(made) + 1
                    if sizes[lang] >= CHUNK:
                        yield flush(lang)
                        del sizes[lang]
                    elif held >= WAITING:
                        largest = sizes.most_common(1)[0][0]
                        yield flush(largest)
                        del sizes[largest]
                        held = sum(sizes.values())
        for lang in list(waiting):
            yield flush(lang)

    return rows.mapInArrow(run, "chunk long, lang string, n_words long, text binary")


_PIECE_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a chunk, cut where pieces end."""
    while len(text) > CHUNK:
        ends = np.flatnonzero(_PIECE_ENDS[np.frombuffer(text, np.uint8, offset=CHUNK)])
        if not len(ends):
            break
        yield text[: CHUNK + int(ends[0])]
        text = text[CHUNK + int(ends[0]) + 1 :]
    yield text


def _blocks(chunks: DataFrame, parts: int, bits: int, longest: int) -> DataFrame:
    """``part, chunk, mass, n, keys, counts``: distinct hashes of a chunk's phrases and their counts, by hash partition."""
    def run(batches):
        edges = np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one text at a time
                words = Words(row["text"], _seed(row["lang"]))
                keys, counts = _tally(np.concatenate([h for _, _, h in words.phrases(longest)]) >> np.uint64(64 - bits))
                cuts = np.append(np.searchsorted(keys, edges), len(keys))
                made = [(p, row["chunk"], int(counts[a:b].sum()), b - a, _squeeze_keys(keys[a:b]), _squeeze(counts[a:b]))
                        for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=names)

    names = ["part", "chunk", "mass", "n", "keys", "counts"]
    return chunks.select("chunk", "lang", "text").mapInArrow(
        run, "part long, chunk long, mass long, n long, keys binary, counts binary")


def _replies(blocks: DataFrame, threshold: int) -> DataFrame:
    """``chunk, n, keys``: the hashes of a chunk that occur at least ``threshold`` times over all chunks."""
    def run(group: pa.Table) -> pa.Table:
        names = ("chunk", "n", "keys", "counts")
        rows = list(zip(*(group[name].to_pylist() for name in names)))
        capacity = sum(group["mass"].to_pylist()) // threshold + 1
        summary, some, size = MisraGries(capacity), [], 0
        for i, (_, n, keys, counts) in enumerate(rows):
            some.append((_expand_keys(keys, n), _expand(counts, n).astype(np.int64)))
            size += n
            if size >= capacity or i == len(rows) - 1:  # parts of about the summary's size merge at once
                summary.merge(*(np.concatenate(x) for x in zip(*some)))
                some, size = [], 0
        alive, total = summary.keys, np.zeros(len(summary.keys), np.int64)
        for _, n, keys, counts in rows:
            keys = _expand_keys(keys, n)
            at = np.searchsorted(keys, alive)
            there = np.flatnonzero(keys[np.minimum(at, n - 1)] == alive)
            total[there] += _expand(counts, n).astype(np.int64)[at[there]]
        frequent = alive[total >= threshold]
        out = []
        for chunk, n, keys, _ in rows:
            own = np.intersect1d(_expand_keys(keys, n), frequent, assume_unique=True)
            if len(own):
                out.append((chunk, len(own), _squeeze_keys(own)))
        columns = zip(*out) if out else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                        names=["chunk", "n", "keys"])

    return blocks.groupBy("part").applyInArrow(run, "chunk long, n long, keys binary")


def _counted(chunks: DataFrame, replies: DataFrame, bits: int, longest: int) -> DataFrame:
    """``lang, words, phrase, f``: the frequent phrases of every chunk, compared by their bytes."""
    def run(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        langs, sizes, phrases, counts = [], [], [], []
        for row in chunk.to_pylist() if answer.num_rows else ():
            keys = np.sort(np.concatenate([_expand_keys(k, n) for k, n in zip(answer["keys"].to_pylist(),
                                                                               answer["n"].to_pylist())]))
            words = Words(row["text"], _seed(row["lang"]))
            for n, at, hashes in words.phrases(longest):
                found = _count(words, n, at, hashes >> np.uint64(64 - bits), keys)
                langs += [row["lang"]] * len(found)
                sizes += [n] * len(found)
                phrases += found.keys()
                counts += found.values()
        return pa.table([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()),
                         pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "f"])

    made = (chunks.select("chunk", "lang", "text").groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(run, "lang string, words int, phrase binary, f long"))
    return made.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f")


_LOW = np.uint64((1 << 22) - 1)


def _count(words: Words, n: int, at: np.ndarray, hashes: np.ndarray, keys: np.ndarray) -> Counter:
    """Occurrences of the phrases of n words whose hash is among the sorted keys."""
    marked = np.zeros(1 << 22, bool)
    marked[keys & _LOW] = True
    some = np.flatnonzero(marked[hashes & _LOW])
    place = np.searchsorted(keys, hashes[some])
    hit = keys[np.minimum(place, len(keys) - 1)] == hashes[some]
    at, place = at[some[hit]], place[hit]
    first = np.full(len(keys), -1)
    first[place[::-1]] = at[::-1]
    same = words.same(at, first[place], n)
    total = np.bincount(place[same], minlength=len(keys))
    text, start, end = words.text, words.start, words.end
    made = Counter()
    for i in np.flatnonzero(total).tolist():
        a = int(first[i])
        made[text[start[a] : end[a + n - 1]]] = int(total[i])
    for a in at[~same].tolist():  # another phrase with the hash of a frequent one
        made[text[start[a] : end[a + n - 1]]] += 1
    return made


def frequent(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, longest: int = LONGEST) -> tuple:
    """``(phrases, totals)``: ``lang, words, phrase, f`` of every phrase of 1 to ``longest`` words with f >= threshold, and
    ``lang, n`` with the number of word occurrences; both are written tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART), min(spark.sparkContext.defaultParallelism, -(-size // CHUNK)))
    bits = min(64, max(size, 1).bit_length() + SPARE_BITS)
    chunks = scratch.keep(_chunks(rows), "phrase-chunks")
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counted = _counted(chunks, _replies(_blocks(chunks, parts, bits, longest), threshold), bits, longest)
    phrases = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    return scratch.keep(phrases, "phrases"), totals


def _wide(x: str | Column) -> Column:
    """A count in a type whose sums and small multiples are exact beyond 64 bits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP,
                 contained: int = CONTAINED_PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``longest`` words of every language.

    The module says what awkward rows mean; ties go to the more frequent phrase, then to the smaller one by its bytes.
    """
    phrases, totals = frequent(docs, scratch or Scratch(docs.sparkSession), threshold, longest)
    candidates = phrases.where("words >= 2").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    def run_of(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("w", start, size), " ")

    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("left"),
                    run_of(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = (cuts.withColumn("twice", F.lit(2 * UNIT).cast("decimal(10,0)") * _wide("a"))
            .withColumn("both", _wide("l") + _wide("r")).withColumn("score", F.expr("twice div both")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = (candidates.where("words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
              .groupBy("lang", run_of(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer")))
    kept = (scored.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * _wide("longer") < contained * _wide("a"))))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def report(docs: DataFrame) -> DataFrame:
    """The query, at the contract's thresholds."""
    return collocations(docs)


def sql(table: str = "documents") -> str:
    """The query in DuckDB SQL; ``table`` may be a subquery."""
    def run(start: str, size: str) -> str:
        return f"array_to_string(list_slice(w, {start}, {start} + {size} - 1), ' ')"

    return rf"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from {table}),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
n as (select lang, sum(len(w))::bigint as n from p group by lang),
z as (select unnest(range(1, {LONGEST + 1})) as z),
g as (select lang, z, {run('i', 'z')} as phrase
      from (select lang, w, z, unnest(range(1, len(w) - z + 2)) as i from p, z where len(w) >= z)),
f as (select lang, z, phrase, count(*) as f from g group by all having count(*) >= {THRESHOLD}),
c as (select lang, z, phrase, f as a, string_split(phrase, ' ') as w from f where z >= 2),
k as (select lang, phrase, a, k, {run('1', 'k')} as first_part, {run('k + 1', 'z - k')} as rest
      from (select *, unnest(range(1, z)) as k from c)),
s as (select k.lang, k.phrase, a, k, l.f as l, r.f as r, (2 * {UNIT}::hugeint * a) // (l.f::hugeint + r.f) as score
      from k join f l on l.lang = k.lang and l.phrase = first_part join f r on r.lang = k.lang and r.phrase = rest
      qualify row_number() over (partition by k.lang, k.phrase order by score, k) = 1),
b as (select lang, {run('i', 'm')} as phrase, max(a) as longer
      from (select *, unnest(range(1, z - m + 2)) as i from (select *, unnest(range(2, z)) as m from c)) group by all),
t as (select s.*, row_number() over (partition by s.lang order by score desc, a desc, encode(s.phrase)) as rank
      from s left join b on b.lang = s.lang and b.phrase = s.phrase
      where longer is null or 100 * longer::hugeint < {CONTAINED_PERCENT} * a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from t join n using (lang) where rank <= {TOP}"""
