"""Quality rules: a threshold table compiled into one projection, without user functions.

Every feature is a column expression over one row, so a document never moves: no join, no shuffle. Repeated three-word
windows are found by sorting a document's own window hashes (64 bits), n log n in its words; shared values are bound by
``let`` so that they are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ASCII_SPACE, let, unused

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50

# Common function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "in", "to", "a", "is", "was", "it", "for", "with", "as", "on", "be", "at", "by", "this", "that",
    "from", "are", "or", "an", "not", "have", "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf",
    "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "er", "le", "la", "les", "de", "et", "un",
    "une", "du", "en", "que", "qui", "dans", "par", "pour", "sur", "pas", "au", "est", "il", "el", "los", "las", "y",
    "se", "del", "por", "con", "no", "una", "su", "al", "lo", "para",
]


@dataclass(frozen=True)
class Rule:
    """A feature over a scale must lie within bounds: ``low * scale <= feature <= high * scale``."""

    name: str
    feature: str
    scale: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Feature and scale name fields of ``features``.
RULES = [
    Rule("mean word length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.25),
    Rule("stop words per word", "n_stop_words", "n_words", 0.01, None),
    Rule("capitals per character", "n_capitals", "word_chars", None, 0.3),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.6),
    Rule("lines ending in an ellipsis", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("lines starting with a bullet", "n_bullet_lines", "n_lines", None, 0.9),
]

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capitals",
            "n_lines", "n_ellipsis_lines", "n_bullet_lines"]


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(ASCII_SPACE))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``."""
    return let(_trim(text), lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, "[ \\t-\\r]+")))


def _repeated(words: Column) -> Column:
    """Number of words inside windows of three words that occur twice or more.

    Sorted hashes show which occur again; only windows whose hash falls into the 64 classes of those are then sorted
    together with their places.
    """
    def bit(h):
        return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))

    def classes(again):
        return F.aggregate(again, F.lit(0).cast("long"), lambda mask, h: mask.bitwiseOR(bit(h)))

    def suspects(hashes, mask):
        return F.filter(F.transform(hashes, lambda h, i: F.when(mask.bitwiseAND(bit(h)) != 0, F.struct(h.alias("h"), i.alias("i")))),
                        lambda x: x.isNotNull())

    def positions(s):
        again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p):
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(p, start, lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    def count(hashes):
        again = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, j: h == F.get(s, j + 1)))
        return let(again, lambda a: F.when(F.size(a) == 0, 0).otherwise(
            let(classes(a), lambda mask: let(F.sort_array(suspects(hashes, mask)), lambda s: covered(positions(s))))))

    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, count)


def features(text: Column) -> Column:
    """The struct of all features of a text as one expression; text, words and lines are computed once."""
    def counts(t, w, lines):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(t, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.size(F.split(t, "[A-Z]")) - 1).cast("long").alias("n_capitals"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "•", "*"))).cast("long")
            .alias("n_bullet_lines"))

    def lines_of(t):
        return F.filter(F.split(t, "\n"), lambda line: _trim(line) != "")

    return let(F.coalesce(text, F.lit("")),
               lambda t: let(words_of(t), lambda w: let(lines_of(t), lambda lines: counts(t, w, lines))))


def _base_failed(f) -> Column:
    return (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words"))


def compile_rules(rules: list[Rule], f) -> Column:
    """One boolean expression: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (f(rule.feature) >= F.lit(rule.low) * f(rule.scale))
        if rule.high is not None:
            verdict = verdict & (f(rule.feature) <= F.lit(rule.high) * f(rule.scale))
    return verdict


def judge(df: DataFrame, column: str = "text", out: str = "quality", rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with ``out``, a struct of all features, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; rows are independent, so repeated rows are judged alike and an empty
    table stays empty. A column already named ``out`` is replaced.
    """
    def verdict(q):
        def f(name):
            return q[name]

        failed, fits = _base_failed(f), compile_rules(RULES if rules is None else rules, f)
        return F.struct(*[f(name).alias(name) for name in FEATURES], failed.alias("base_failed"),
                        (~failed & fits).alias("kept"))

    return df.withColumn(out, let(features(F.col(column)), verdict))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, the base counts, base_failed and kept."""
    q = judge(docs.select("doc_id", "text"), "text", "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[F.col("quality")[name].alias(name) for name in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    names = docs.columns
    q = unused(docs, "__quality")
    return judge(docs, "text", q).where(F.col(q)["kept"]).select(*names)


def sql(table: str = "documents") -> str:
    """The query in DuckDB SQL; ``table`` may be a subquery."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    conditions = []
    for rule in RULES:
        if rule.low is not None:
            conditions.append(f"{rule.feature} >= {rule.low}::double * {rule.scale}")
        if rule.high is not None:
            conditions.append(f"{rule.feature} <= {rule.high}::double * {rule.scale}")
    verdict = " and ".join(conditions)
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from {table}),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
h as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as k from g),
again as (select r, i from (select r, i, count(*) over (partition by r, k) as c from h) where c > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([i, i+1, i+2]) as p from again) group by r),
f as (select w.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals, len(l)::bigint as n_lines,
        len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, '…')))::bigint as n_ellipsis_lines,
        len(list_filter(l, lambda x: left(x, 1) in ('-', '•', '*')))::bigint as n_bullet_lines
      from w left join covered using (r)),
b as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and {verdict}) as kept from b"""
