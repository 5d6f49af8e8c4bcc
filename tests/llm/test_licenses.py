"""License scan against SQL, plain loops and altered notices."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from flowlens.llm import licenses, queries  # noqa: E402

SCHEMA = "doc_id long, text string, t string, label long, w int, k int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = dict(licenses.NOTICES)


def scanned(spark, texts, **options):
    rows = [(i, text, "clash", 1, 2, 3) for i, text in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text):
    """Label and start of every phrase, by plain search."""
    words = split(text)
    return sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(words))
                  if words[i : i + len(phrase.split())] == phrase.split())


def test_equals_sql(spark, sf_dir):
    sql = queries.ORACLES["op11_license_scan"]
    assert compare(queries.QUERIES["op11_license_scan"](spark, sf_dir), connect(sf_dir), sql) == ""


def test_base_equals_plain_search(spark):
    draw = random.Random(3)
    pool = ["MIT", "License", "apache", "general", "PUBLIC", "license.", "é", "\n", "-", "mit-license", "x" * 50, "İ"]
    texts = [" ".join(draw.choices(pool, k=draw.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", " ,.", "mit license " * 20_000, "word " * 100_000 + "Apache\x00License", "mit license"]
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        want = places(text)
        assert (got[i].n_base, got[i].base_labels) == (len(want), ",".join(sorted({label for _, label in want})))
        assert (got[i].first_word, got[i].last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert got[i].n_words == len(split(text))
    assert got[62].labels == got[60].labels == "" and got[60].score == 0.0


@pytest.mark.parametrize("label", ["mit", "isc", "bsd", "apache", "gpl", "mpl", "unlicense", "zlib"])
def test_altered_notices(spark, label):
    filler, words = "lorem ipsum dolor sit amet " * 40, NOTICE[label].split()
    draw = random.Random(label)
    holes = [w for w in words if draw.random() > 0.03]
    more = [x for w in words for x in ([w, "indeed"] if draw.random() < 0.03 else [w])]
    texts = [NOTICE[label], filler + NOTICE[label].upper() + filler, " ".join(holes), " ".join(more),
             "\n * ".join(words), NOTICE[label] + filler + NOTICE[label], " ".join(words[: len(words) // 2]),
             " ".join(draw.sample(words, len(words)))]
    got = scanned(spark, texts)
    own = [label in got[i].labels.split(",") for i in range(len(texts))]
    assert own[:6] == [True] * 6 and got[0].score == got[5].score == 1.0
    if label not in ("apache", "gpl"):  # their phrases are there in any case
        assert own[6:] == [False, False] and got[7].score == 0.0


def test_short_notices_are_told_apart(spark):
    kinds = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
    got = scanned(spark, [f"Text.\nLicensed under CC {kind} 4.0." for kind in kinds] + ["CC BY-NC 4.0 " * 3])
    assert [got[i].labels for i in range(len(kinds))] == ["cc-" + kind.lower() for kind in kinds]


def test_spans_repeats_and_own_templates(spark):
    own = [licenses.Template("house", "all rights reserved by the house of words"), licenses.Template("one", "secret", True)]
    text = "a b all rights reserved by the house of words c secret"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    rows, found = licenses.spans(docs, own)
    assert rows.count() == 4
    assert {(r.doc_id, r.label, r.start, r.stop, r.share) for r in found.collect()} == {
        (i, *span) for i in (1, None) for span in (("house", 2, 10, 1.0), ("one", 11, 12, 1.0))}
    got = licenses.scan(docs, own).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in got) == [
        (0, "house,one", 1), (1, "house,one", 1), (1, "house,one", 1), (2, "", 0)]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_join_without_broadcast(spark, monkeypatch):
    texts = [NOTICE["mit"], "under the MIT License", None]
    want = {i: (r.labels, r.n_base, r.score) for i, r in scanned(spark, texts).items()}
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 0)
    assert {i: (r.labels, r.n_base, r.score) for i, r in scanned(spark, texts).items()} == want
