"""Collocations against SQL and a plain count; the summaries against their bound."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from flowlens.llm import phrases, queries  # noqa: E402
from flowlens.llm.common import Scratch  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, f long, chunk int, words int"


def plain(rows, top=2000):
    """The contract by dictionaries."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                count[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if a >= 30 and len(p) > 1}
        best = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in often.items() if len(q) > len(p)
                      and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, text, lang, 1, 2, 3) for i, (lang, text) in enumerate(rows)], SCHEMA)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).select(*names).collect())


def corpus():
    draw = random.Random(8)
    vocabulary = ["The", "of", "é", "日本", "İx", "a" * 9, "b" * 17, "ab\x00c", "don't", "x-y", "New", "York", "city"]
    rows = []
    for i in range(900):
        words = draw.choices(vocabulary, weights=range(13, 0, -1), k=draw.randrange(0, 60))
        rows.append((draw.choice(["en", "en", "de", None, ""]),
                     "".join(w + draw.choice([" "] * 12 + ["  ", "\t", ", ", ".\n", " ; "]) for w in words)))
    rows += [("en", "  new york city hall of records \n" * 40), ("en", None), (None, ""), ("en", " .,;\t\n "),
             ("de", "word " * 100), ("fr", "only once"), ("fr", "q" * 300_000), ("es", "la casa azul. " * 30)] * 2
    return rows


def test_equals_sql(spark, sf_dir):
    sql = queries.ORACLES["op12_phrase_collocations"]
    assert compare(queries.QUERIES["op12_phrase_collocations"](spark, sf_dir), connect(sf_dir), sql) == ""


def test_equals_plain_count(spark, monkeypatch):
    rows = corpus()
    want = plain(rows)
    assert len(want) > 100 and got(spark, rows) == want
    assert got(spark, rows, top=5) == plain(rows, 5)
    for name, value in (("CHUNK", 700), ("WAITING", 1500), ("PART", 500)):  # many chunks, parts and cut texts
        monkeypatch.setattr(phrases, name, value)
    assert got(spark, rows) == want


def test_colliding_hashes_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SPARE_BITS", -10)  # hashes of a few bits: most phrases share one
    rows = corpus()
    assert got(spark, rows) == plain(rows)


def test_nothing_to_count(spark):
    assert got(spark, []) == [] and got(spark, [("en", None), (None, "")]) == [] and got(spark, [("en", "a b c")]) == []


def test_totals(spark):
    rows = corpus()
    docs = spark.createDataFrame([(text, lang) for lang, text in rows], "text string, lang string")
    _, totals = phrases.frequent(docs, Scratch(spark))
    want = Counter()
    for lang, text in rows:
        want["und" if lang is None else lang] += len(re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", text or ""))
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in want.items() if v}


def test_summary_keeps_every_frequent_key():
    draw = np.random.default_rng(1)
    for threshold in (5, 30):
        keys = draw.zipf(1.3, 20_000).clip(0, 1 << 40).astype(np.uint64)
        summary = phrases.MisraGries(len(keys) // threshold + 1)
        for part in np.array_split(keys, 17):
            one = phrases.MisraGries(summary.capacity)
            one.merge(*phrases._tally(part))
            summary.merge(one.keys, one.counts)
        true = Counter(keys.tolist())
        left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert len(left) <= summary.capacity
        assert all(left.get(key, 0) > f - threshold and left.get(key, 0) <= f for key, f in true.items() if f >= threshold)


def test_blocks_keep_their_numbers():
    draw = np.random.default_rng(2)
    for top in (3, 1 << 20, 1 << 63):
        values = np.sort(draw.integers(0, top, 1000, dtype=np.uint64))
        assert (phrases._expand(phrases._squeeze(values), 1000) == values).all()
        assert (phrases._expand_keys(phrases._squeeze_keys(values), 1000) == values).all()
