"""Null, empty, repeated and clashing rows of the training-data operators, and small brute-force versions."""

import os
import random
import re
import sys
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowlens.llm import (  # noqa: E402
    bpe, decontaminate, langid, pii, quality, simhash, token_counts, toxicity, urls,
)
from flowlens.llm.common import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["__made", "__place", "__moved", "__quality", "__key", "__rules", "__best", "text_hash", "lang_pred", "score", "fp"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    return df.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for name in CLASH})


def test_token_counts_of_nulls_repeats_and_nothing(spark, empty):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "one two"), (3, "one two")], "doc_id long, text string")
    assert {r.n_tokens: r.n_docs for r in token_counts.report(docs).collect()} == {0: 3, 2: 2}
    assert token_counts.report(empty).collect() == [] and token_counts.at_limits(token_counts.report(empty), [5]).collect() == []


def test_words_stay_known_over_generations(monkeypatch):
    vocab = bpe.Vocabulary(bpe.default_path(), bpe.default_pattern())
    monkeypatch.setattr(bpe, "MEMO", 40)
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 9) + draw.choice(["", "ü", "日"]) for _ in range(30))
             for _ in range(200)]
    got = []
    for text in texts:  # a group of its own each
        got += vocab.encode_all([text])
        assert len(vocab.memo) <= 40 + 30 and vocab.old.keys() | vocab.memo.keys()
    fresh = bpe.Vocabulary(bpe.default_path(), bpe.default_pattern())
    monkeypatch.setattr(bpe, "MEMO", 200_000)
    assert got == list(fresh.encode_all(texts)) and [len(p) // 4 for p in got] == list(fresh.count_all(texts))
    ids = np.frombuffer(b"".join(got), "<i4")
    rows = fresh.decode_rows(ids, np.array([len(p) // 4 for p in got]))
    assert [bytes(x.as_py()).decode() for x in rows] == texts
    for bad in ([-1], [10**6], [50256]):
        with pytest.raises(ValueError):
            fresh.decode(np.array(bad))


def test_bpe_of_nothing(empty):
    assert bpe.report(empty).collect() == [] and bpe.decode(bpe.encode(empty), "ids").collect() == []


def test_account_and_phone_numbers_keep_their_form():
    for iban in ("DE89370400440532013000", "ES9121000418450200051332", "GB29NWBK60161331926819"):
        made = pii.surrogate("iban", iban, "k", 0)
        assert made != iban and made[:2] == iban[:2] and len(made) == len(iban) and pii._mod97(made[4:] + made[:4]) == 1
    for mention, code in (("+49 301 234 5678", "+49"), ("+1 (843) 555-7672", "+1"), ("+420 601 123 456", "+420")):
        (start, end, kind, value), = pii.detect(mention)
        made = pii.render(kind, mention, pii.surrogate(kind, value, "k", 0))
        assert (start, end, kind) == (0, len(mention), "phone") and made.startswith(code) and made != mention
        assert re.sub(r"\d", "0", made) == re.sub(r"\d", "0", mention)


@pytest.mark.parametrize("max_sent", [50_000, -1])
def test_surrogates_leave_other_columns_alone(spark, empty, max_sent):
    rows = [(1, "Mail a@example.com", "en", "s", 18), (None, None, None, None, None), (1, "Mail a@example.com", "en", "s", 18)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    made = pii.protect(docs, "k", max_sent=max_sent)
    assert made.columns == docs.columns and made.drop("text").exceptAll(docs.drop("text")).isEmpty() and made.count() == 3
    texts = [r.text for r in made.where("doc_id = 1").collect()]
    assert texts[0] == texts[1] != "Mail a@example.com"
    assert pii.report(empty).collect() == []


def all_segmentations(word, known, p, unknown):
    """Probability of a word as the sum over every way to cut it, one by one."""
    @lru_cache(None)
    def cuts(rest):
        if not rest:
            return [()]
        out = []
        for n in range(1, len(rest) + 1):
            piece = known.get(rest[:n], unknown if n == 1 else None)
            if piece is not None:
                out += [(piece, *tail) for tail in cuts(rest[n:])]
        return out

    return sum(np.prod([p[piece] for piece in cut]) for cut in cuts("▁" + word))


def test_language_scores_equal_enumerated_segmentations():
    import sentencepiece

    path = langid.default_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size())
                          if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    known = {name: i for i, name in enumerate(names)}
    n = langid.trie(path).n
    p = np.random.default_rng(3).random((n + 1, 2))
    p /= p.sum(axis=0)
    words = ["the", "x", "straße", "日本語", "abcab", "zzzz", "haus"]
    got = langid.Lattices(words, path).log_likelihood(p)
    for i, word in enumerate(words):
        for c in (0, 1):
            assert got[i, c] == pytest.approx(np.log(all_segmentations(word, known, p[:, c], n)), abs=1e-9)

    def forward(word, q):  # in logarithms, piece by piece
        marked = "▁" + word
        at = [0.0] + [-np.inf] * len(marked)
        for j in range(1, len(marked) + 1):
            terms = [at[i] + np.log(q[piece]) for i in range(max(0, j - 16), j)
                     if (piece := known.get(marked[i:j], n if j == i + 1 else None)) is not None]
            at[j] = np.logaddexp.reduce(terms)
        return at[-1]

    draw = random.Random(5)
    long = ["".join(draw.choices("etaoinshrdlu", k=k)) for k in (22, 23, 24, 47, 48, 150, 1200)]  # rescaled on the way
    for word, own in zip(long, langid.Lattices(long, path).log_likelihood(p)):
        assert own[0] == pytest.approx(forward(word, p[:, 0]), rel=1e-9)
    q = p[:, 0]
    for word in ("haus", long[2], long[4], long[5]):  # expected uses are the slopes of the logarithm
        use = langid.Lattices([word], path).expected(q, np.ones(1))
        for piece in np.flatnonzero(use)[:4]:
            up, down = q.copy(), q.copy()
            up[piece] *= np.exp(1e-5)
            down[piece] *= np.exp(-1e-5)
            slope = np.subtract(*[langid.Lattices([word], path).log_likelihood(x[:, None])[0, 0] for x in (up, down)]) / 2e-5
            assert use[piece] == pytest.approx(slope, abs=1e-4)


def test_language_of_awkward_tables(spark, empty, monkeypatch):
    assert langid.report(empty).collect() == []
    rows = [(i, "the house and the river" if i % 2 else "das Haus und der Fluss", "en" if i % 2 else "de", "s", 1)
            for i in range(60)]
    docs = clashing(spark.createDataFrame(rows + rows[:20], DOCS))
    model = langid.train(docs)
    made = langid.predict(docs, model, out="score")
    assert model[0] == ["de", "en"] and made.columns == docs.columns
    assert made.count() == 80 and made.where("score.lang_pred = lang").count() == 80
    none = langid.predict(docs, langid.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {(r.language.lang_pred, r.language.score) for r in none.collect()} == {("und", 0.0)}
    texts = [" ".join(random.Random(i).choices(["haus", "river", f"wort{chr(97 + i % 26)}", "fluss"], k=20)) for i in range(60)]
    table, path = np.random.default_rng(1).random((langid.trie(langid.default_path()).n + 1, 2)), langid.default_path()
    want = list(langid.Scorer(table, path).score(texts))
    monkeypatch.setattr(langid, "MEMO", 5)
    scorer = langid.Scorer(table, path)
    got = [next(iter(scorer.score([text]))) for text in texts]  # every text makes a new generation
    assert np.allclose(want, got)


def test_simhash_of_nothing_and_null_ids(spark, empty):
    assert simhash.report(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.report(docs).collect())
    same = got[-1][1]
    assert got == [(0, "0" * 16, None), (0, "0" * 16, None), (0, same, 7), (7, same, 7)]
    kept = simhash.keep_one(clashing(docs.withColumns({"lang": F.lit("x")})).unionByName(clashing(docs.withColumn("lang", F.lit("x")))))
    assert sorted((r.doc_id or 0, r["__key"]) for r in kept.collect()) == [(0, "__key?"), (7, "__key7")]


def test_every_alias_of_a_page_counts(spark, sf_dir):
    link = "<LINK href='http://a.net/p?x=1&amp;y=2' rel=canonical><link rel=canonical href=//free.xyz/z><meta content='http://b.xyz/' property='og:url'>"
    rows = [(1, "http://a.net/p?x=1&y=2", ""), (2, "http://shop.xyz/q", link), (3, "http://free.xyz/z", None),
            (4, "http://b.xyz/", ""), (5, "http://other.xyz/", "")]
    pages = spark.createDataFrame([(*row, "own", "own") for row in rows],
                                  "page_id long, url string, html string, __rules string, __best string")
    got = urls.judge(pages, urls.rules_table(spark))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    con = connect(sf_dir)
    values = ", ".join("({}::bigint, '{}', {})".format(i, u, "null" if h is None else "'" + h.replace("'", "''") + "'") for i, u, h in rows)
    assert compare(got, con, urls.sql(f"(select * from (values {values}) t(page_id, url, html))")) == ""
    assert urls.judge(pages.limit(0), urls.rules_table(spark)).collect() == []
    hosts = pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "__rules", "__best")
    ruled = urls.longest_rule(hosts, urls.rules_table(spark), Scratch(spark))
    assert ruled.columns == ["host", "path", "__rules", "__best", "rule", "rule_verdict"]
    assert {r["__best"] for r in ruled.collect()} == {"own"}


def test_benchmark_and_quality_of_nothing(spark, empty):
    items = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert decontaminate.report(empty, items).collect() == [] and quality.report(empty).collect() == []
    assert decontaminate.keep_clean(clashing(empty), items).columns == clashing(empty).columns
    good = clashing(spark.createDataFrame([(1, "It was the best of the times, and this is it. " * 1 + " ".join(f"word{i}" for i in range(60)), "en", "s", 1)], DOCS))
    assert [r["__quality"] for r in quality.keep_good(good).collect()] == ["__quality1"]


def test_benchmark_join_without_broadcast(spark, sf_dir, monkeypatch):
    """Beyond the limit the same rows come from a shuffle in which no text moves."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(tuple(r) for r in decontaminate.report(docs, items).select(*names).collect())
    clean = sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(tuple(r) for r in decontaminate.report(docs, items).select(*names).collect()) == want
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect()) == clean
    vocabulary = spark.range(9).select(F.xxhash64("id").alias("token"))
    plan = decontaminate._document_tokens(docs, [4], vocabulary, False)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "around" in join and decontaminate.keep_clean(docs, items.limit(0)).count() == docs.count()


def plain_label_model(votes, labels, rounds):
    """The label model voter by voter, in plain loops."""
    both = [[*map(float, row), float(y)] for row, y in zip(votes, labels)]
    n, m = len(both), len(both[0])
    posterior = [y * 0.98 + 0.01 for y in labels]
    for step in range(rounds):
        mass = [sum(1 - q for q in posterior), sum(posterior)]
        speaks = [[(sum((q if c else 1 - q) * row[j] for q, row in zip(posterior, both)) + 0.5) / (mass[c] + 1)
                   for j in range(m)] for c in (0, 1)]
        if step in (0, rounds // 2):
            centred = [[row[j] - speaks[1 if q > 0.5 else 0][j] for j in range(m)] for row, q in zip(both, posterior)]
            cov = [[sum(r[i] * r[j] for r in centred) / n for j in range(m)] for i in range(m)]
            sd = [max(cov[j][j], 1e-9) ** 0.5 for j in range(m)]
            corr = [[cov[i][j] / (sd[i] * sd[j]) for j in range(m)] for i in range(m)]
            share = [1 / max(sum(corr[i][j] for i in range(m) if corr[i][j] > 0.05), 1) for j in range(m)]
        new = []
        for row in both:
            logit = np.log(mass[1] / mass[0])
            for j in range(m):
                logit += share[j] * (np.log(speaks[1][j] / speaks[0][j]) if row[j] else
                                     np.log((1 - speaks[1][j]) / (1 - speaks[0][j])))
            new.append(1 / (1 + np.exp(-min(30, max(-30, logit)))))
        done = max(abs(a - b) for a, b in zip(new, posterior)) < 1e-4
        posterior = new
        if done:
            break
    return posterior


def test_label_model_equals_plain_loops():
    draw = np.random.default_rng(9)
    labels = draw.random(120) < 0.4
    votes = np.stack([np.where(labels, draw.random(120) < a, draw.random(120) < b)
                      for a, b in ((0.7, 0.1), (0.5, 0.2), (0.6, 0.05), (0.3, 0.3))], axis=1).astype(np.float32)
    votes = np.column_stack([votes, votes[:, 0]])  # the same evidence twice
    posterior, _, corr = toxicity.label_model(votes, labels.astype(float), 6)
    assert np.allclose(posterior, plain_label_model(votes, labels, 6), atol=1e-3) and corr[0, 4] == pytest.approx(1, abs=1e-3)
    weights, bias = toxicity.fit_linear(votes, posterior)
    slope = votes.T @ (1 / (1 + np.exp(-(votes @ weights + bias))) - posterior) + toxicity.RIDGE * weights
    assert np.abs(slope).max() < 1e-4  # the loss has no slope left


def test_toxicity_of_awkward_tables(spark, empty, monkeypatch):
    rows = [(i, ("you are a vile grub " if i % 3 == 0 else "the river was calm ") + f"day {i % 7}", "en", "s", 1) for i in range(300)]
    docs = clashing(spark.createDataFrame(rows + rows[:50] + [(None, None, None, None, None), (900, "", "en", "s", 0)], DOCS))
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1), (6, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, marks)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count() and all(by_id[i].predicted == (i % 3 == 0) for i in range(300))
    assert by_id[None].score == by_id[900].score and by_id[None].held_out
    monkeypatch.setattr(toxicity, "MAX_BROADCAST", 0)
    assert {r.doc_id: r.predicted for r in toxicity.report(docs, marks).collect()} == {i: r.predicted for i, r in by_id.items()}
    assert toxicity.report(empty, marks).collect() == [] and toxicity.report(docs, marks.limit(0)).count() == docs.count()
    model = toxicity.train(docs, marks)
    replaced = toxicity.score(docs, model, out="score")
    assert replaced.columns == docs.columns and dict(replaced.dtypes)["score"] == "double"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf_dir, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, sf_dir).collect() == []
    prose = "It was the best of times, and it was the worst of the times for all of us in that old town by the river. "
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, prose * 8, None, "b", 9),
            (3, prose + " ".join(f"w{i}" for i in range(80)), "en", "a", 5), (3, prose + " ".join(f"w{i}" for i in range(80)), "en", "a", 5),
            (4, "ab cd " * 60_000, "de", "c", 360_000), (5, "Write to a.b@example.com now", "en", "a", 28)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    made = stage(spark, docs, sf_dir)
    ids = sorted((r.doc_id or 0) for r in made.collect())
    if name != "byte_bpe":
        assert made.columns == docs.columns
    want = {"quality_rules": [3, 3], "near_duplicates": [0, 1, 3, 4, 5], "decontamination": [0, 1, 2, 2, 3, 3, 4, 5],
            "pii_surrogates": [0, 1, 2, 2, 3, 3, 4, 5], "byte_bpe": [0, 1, 2, 2, 3, 3, 4, 5]}
    assert ids == want[name]
    if name == "pii_surrogates":
        kept = {r.doc_id: r for r in made.collect()}
        assert kept[5].text != rows[-1][1] and kept[5].n_chars == len(kept[5].text) and kept[1].n_chars is None
    if name == "byte_bpe":
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in made.collect())
