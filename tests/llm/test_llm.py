"""The training-data operators against brute force, exact round trips, held-out accuracy and awkward rows."""

import base64
import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowlens.llm import (  # noqa: E402
    bpe, components, decontaminate, html, langid, pii, quality, queries, simhash, token_counts, toxicity, urls,
)
from flowlens.llm.common import Scratch, table  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "ab cd " * 60_000
AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some text", None, "b", 9),
           (3, "x" * 300_000, "en", "a", 300_000), (4, LONG, "de", "c", len(LONG)), (5, " \n\t ", None, None, 4),
           (6, "é日本 🙂<|endoftext|>   ", "fr", "a", 5), (7, "12345 !!! ...", "en", "a", 13)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    return {doc_id: text or "" for doc_id, text in rows}


def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == ""


def test_token_counts(spark, sf_dir, texts):
    enc = reference_encoding()
    sizes = sorted(len(enc.encode_ordinary(t)) for t in texts.values())
    sums = queries.op1_token_counts(spark, sf_dir)
    for row in sums.collect():
        n = row.n_tokens
        assert row.n_docs == sizes.count(n) and row.docs_from == sum(s >= n for s in sizes)
        assert row.tokens_from == sum(s for s in sizes if s >= n)
        assert row.tokens_truncated == sum(min(s, n) for s in sizes)
    limits = {r.limit: (r.tokens_truncated, r.docs_over) for r in token_counts.at_limits(sums, [0, 100, 10**7]).collect()}
    assert limits == {x: (sum(min(s, x) for s in sizes), sum(s > x for s in sizes)) for x in (0, 100, 10**7)}
    got = {r.p: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert got == {0.5: sizes[-(-len(sizes) // 2) - 1], 1.0: sizes[-1]}


def test_encoding_equals_tiktoken_and_decodes(spark, sf_dir, awkward, texts):
    enc = reference_encoding()
    for row in queries.op2_byte_bpe(spark, sf_dir).collect():
        ids = np.array(enc.encode_ordinary(texts[row.doc_id]), "<u4")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    made = bpe.encode(awkward.withColumn("ids", F.lit("clash")), "text", "ids")
    for row in bpe.decode(made, "ids", "decoded").collect():
        assert bytes(row.decoded).decode() == (row.text or "")
        if len(row.text or "") < 1000:
            assert row.ids == enc.encode_ordinary(row.text or "")


def test_perfect_hash_is_a_bijection():
    keys = [str(i).encode() for i in range(5000)]
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(5000))


def test_html_keeps_the_article(spark):
    prose = "This is the story of a town by the river, and it was told to all of them for many years with great care. " * 3
    page = (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/a'>Home</a> <a href='/b'>Shop</a>"
            f"</nav><article><p>{prose}</p><p>{prose}&amp; more</p></article><script>var x = 1;</script>"
            f"<footer>&copy; 2020 All rights reserved</footer></body></html>")
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 3000)]
    got = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 5 and by_id[2] == by_id[3] == by_id[4] == ""
    assert by_id[1] == " ".join([prose.strip(), prose.strip() + " & more"])


PROSE = {
    "en": "The committee published its yearly report on Tuesday, and most readers agreed that river traffic had grown faster "
          "than anyone expected. Ship owners said they would order larger boats, while towns along the banks asked for money "
          "to repair old harbour walls.",
    "de": "Der Ausschuss legte am Dienstag seinen Jahresbericht vor, und viele Leser fanden, dass der Verkehr auf dem Fluss "
          "schneller gewachsen war als erwartet. Reeder wollen größere Schiffe bestellen, während die Städte am Ufer Geld "
          "verlangen, um alte Hafenmauern zu erneuern.",
    "fr": "Le comité a publié mardi son rapport annuel, et la plupart des lecteurs ont constaté que le trafic du fleuve "
          "augmentait plus vite que prévu. Les armateurs veulent commander des bateaux plus grands, tandis que les villes "
          "riveraines demandent des fonds pour réparer leurs vieux quais.",
    "es": "El comité publicó el martes su informe anual, y muchos lectores vieron que el tráfico del río crecía más rápido de "
          "lo esperado. Los armadores quieren encargar barcos mayores, mientras las ciudades de la orilla piden dinero para "
          "reparar viejos muros del puerto."}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_html_without_article(lang):
    prose, menu = PROSE[lang], "<div><a href='/a'>Home</a> <a href='/b'>Shop</a></div>"
    first, second = prose.split(". ")

    def text(*parts):
        return html.main_text("<body>" + menu + "".join(f"<div>{x}</div>" for x in parts) + "<div>© 2020</div></body>")

    assert text(prose, prose) == f"{prose} {prose}"
    assert text(f"{first}.", second) == prose  # near-good blocks only
    assert text(" ".join(first.split()[:7])) == " ".join(first.split()[:7])  # a short one only
    assert text("Home", "Contact") == ""
    links = "".join(f"<li><a href='/{x}'>Sitemap {x} archive overview downloads products pictures {x} index</a></li>" for x in "pq")
    page = f"<article><p>{prose}</p><p><a href='/s'>{prose}</a></p><ul>{links}</ul></article>"
    assert html.main_text(page) == f"{prose} {prose}"
    assert html.main_text(f"<article><h1>Title</h1></article><div>{prose}</div>") == f"Title {prose}"


def test_surrogates(spark, awkward):
    rows = [(1, "Mail anna@example.com or call +1 (212) 555-0199."), (2, "Again anna@example.com, card 4111 1111 1111 1111"),
            (3, "Mr John Miller met Mary Stone; Miller left."), (4, "token = \"0a1b2c3d4e5f60718293\" ip 10.1.2.3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (50_000, -1):
        out = {r.doc_id: r for r in pii.protect(docs, "k", spans="s", max_sent=limit).collect()}
        mail = [next(x.surrogate for x in out[i].s if x.kind == "email") for i in (1, 2)]
        assert mail[0] == mail[1] != "anna@example.com" and mail[0].endswith(".com")
        for doc_id, text in rows:
            kinds = [kind for _, _, kind, _ in pii.detect(text)]
            assert [x.kind for x in out[doc_id].s] == kinds and len(kinds) >= 2
            for start, end, _, _ in pii.detect(text):
                if "given" not in str(kinds):
                    assert text[start:end] not in out[doc_id].text
            for x in out[doc_id].s:
                assert out[doc_id].text[x.start : x.end] == x.surrogate
        names = [x.surrogate for x in out[3].s if x.kind == "surname"]
        assert names[0] == names[-1] and names[0] != names[1]
        card = next(x.surrogate for x in out[2].s if x.kind == "card")
        assert re.fullmatch(r"4\d{3}( \d{4}){3}", card) and pii._luhn(card.replace(" ", "")) == 0
    same = pii.protect(awkward, "k").select("doc_id", "text")
    clean = awkward.where("doc_id <> 7 or doc_id is null").select("doc_id", "text")
    assert clean.exceptAll(same).isEmpty() and same.count() == len(AWKWARD)
    assert pii.protect(docs.limit(0), "k").count() == 0


ADJACENT = {"phone": ["+1 (843) 555-7672", "+49 301 234 5678", "555-123-4567", "+45 12.34.56.78", "+14155550123"],
            "card": ["4031065727380220", "4111 1111 1111 1111", "3782-822463-10005"], "ip": ["170.106.47.218", "8.8.8.8"],
            "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "ES9121000418450200051332"]}


def test_adjacent_entities_stay_apart():
    own = [(kind, mention) for kind, mentions in ADJACENT.items() for mention in mentions]
    for kind, mention in own:
        for kind2, mention2 in own:
            for rest in ("", ".", " 4.5"):
                text = f"{mention} {mention2}{rest}"
                found = [(k, text[a:b]) for a, b, k, _ in pii.detect(text)]
                assert found == [(kind, mention), (kind2, mention2)], text
    for text in ("4031065727380220 12 items", "4031065727380220 170.5", "+1 (843) 555-7672 12 items"):
        assert [text[a:b] for a, b, _, _ in pii.detect(text)] == [re.split(r" 1[27]", text)[0]]
    assert [k for _, _, k, _ in pii.detect("1234567890 170.106.47.218")] == ["ip"]


def test_language_on_held_out(spark, sf_dir, awkward):
    got = queries.op5_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    und = {r.doc_id: r.lang_pred for r in langid.report(awkward).collect()}
    assert und[1] == und[2] == und[5] == und[7] == "und"


def test_simhash_equals_brute_force(spark, sf_dir, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", root(i)) for i in fps}
    kept = corpus_pipeline.near_duplicates(spark, table(spark, sf_dir, "documents"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in fps})


def test_near_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**62), 2**62, 60)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, d, replace=False)) for b in base for d in (0, 1, 2, 4, 5, 6)})
    marked = spark.createDataFrame([(i, fp) for i, fp in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components_of(marked, Scratch(spark)).collect()}
    least = list(range(len(fps)))
    near = [(a, b) for a in least for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4]
    for _ in fps:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert got == dict(enumerate(least))


def test_tables_of_keys_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded keys by the table they come from, which is under its limit long after the keys are not."""
    plans, keep = {}, Scratch.keep

    def spied(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", spied)
    fps = spark.createDataFrame([(fp, 1) for fp in (0, 1, 3, 2**40, 2**40 + 1, 7 << 50)], "fp long, n long")
    found = simhash.link_fingerprints(fps, Scratch(spark)).collect()
    assert {r.fp for r in found} == {0, 1, 3, 2**40, 2**40 + 1, 7 << 50}
    for name in ("shared-keys", "open-keys"):
        assert "Join" in plans[name] and "Broadcast" not in plans[name]


def test_keep_one_of_awkward_rows(spark, awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 5 not in ids and None in ids and {3, 4, 6, 7} <= set(ids)
    twice = awkward.where("doc_id = 6").unionByName(awkward.where("doc_id = 6"))
    assert simhash.keep_one(twice).count() == 1
    assert simhash.keep_one(awkward.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "c"), ("x", "y"), (None, "a"), ("a", "b")], "a string, b string")
    got = {r.node: r.component for r in components.connected_components(edges, Scratch(spark)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_aliases_inherit_blocks(spark):
    canonical = "<link rel='canonical' href='http://a.net/p'>"
    rows = [(1, "http://a.net/p", ""), (2, "http://shop.xyz/q", canonical), (3, "http://w.org/fr/z", canonical),
            (4, "http://other.xyz/", None), (5, None, canonical), (6, "nothing", ""), (4, "http://other.xyz/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, urls.rules_table(spark)).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"),
                   6: (None, "allow")}  # the allowed alias 3 goes before the block of 1
    got = {r.page_id: r.verdict for r in urls.judge(pages.where("page_id <> 3"), urls.rules_table(spark)).collect()}
    assert got[2] == "block"


def test_decontamination_of_awkward_rows(spark, awkward):
    items = spark.createDataFrame([("i1", "ab cd " * 8), ("i2", "some text"), ("i3", None), (None, "12345")],
                                  "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(awkward, items).collect()]
    assert len(got) == len(AWKWARD)
    by_id = {row[0]: row[1:] for row in got}
    assert by_id[4] == (120_000, 120_000, ["i1"], True) and by_id[None] == (2, 2, ["i2"], True)
    assert by_id[1] == (0, 0, [], False) and by_id[7] == (1, 1, [], True)
    assert decontaminate.keep_clean(awkward, items).count() == len(AWKWARD) - 3
    assert decontaminate.keep_clean(awkward, items.limit(0)).count() == len(AWKWARD)


def test_quality_of_awkward_rows(spark, awkward):
    view = awkward.select("doc_id", F.col("text"))
    got = {r.doc_id: r for r in quality.report(view).collect()}
    assert (got[4].n_words, got[4].n_repeat_words, got[4].base_failed) == (120_000, 120_000, True)
    assert not got[1].kept and got[1].n_words == 0 and got[3].word_chars == 300_000
    assert quality.judge(awkward.withColumn("quality", F.lit(1))).columns[-1] == "quality"


def test_toxicity_on_held_out(spark, sf_dir, awkward):
    got = queries.op10_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    rows = got.where("held_out and toxic is not null").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.85
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.report(awkward, empty).collect())


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    docs = table(spark, sf_dir, "documents")
    good = {r.doc_id for r in quality.report(docs).where("kept").collect()}
    marked = simhash.near_duplicates(docs.where(F.col("doc_id").isin(sorted(good)))).collect()
    one = {r.component_id for r in marked}
    dirty = {r.doc_id for r in decontaminate.report(docs, table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(one - dirty)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
