"""Classifiers, page text, vector search, preference pairs and the pipeline."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracesift.llm import covertree, htmltext, langid, preference, quality, queries, toxicity
from tracesift.llm.common import fold, table

FOLDER = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long")


def held_out_errors(spark, name, label):
    got = queries.QUERIES[name](spark, FOLDER)
    joined = got.join(table(spark, FOLDER, "labels").select(F.col("doc_id"), F.col(label).alias("label")), "doc_id").where("held_out").toPandas()
    assert len(joined) > 30
    return joined


def test_fold_matches_crc32(spark):
    import zlib

    got = spark.range(200).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_quality_on_held_out_documents(spark):
    found = held_out_errors(spark, "op1_quality_classifier", "quality")
    assert (found["predicted"] == found["label"]).mean() > 0.93
    assert found["score"].between(0, 1).all()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + quality.STATS
    m = quality.Machine(0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.3, (size, quality.RANK)), np.zeros(quality.STATS), np.full(quality.STATS, 0.25))
    buckets, values, stats = np.array([3, 9, 400]), np.array([0.5, 0.2, 0.8]), rng.uniform(-0.2, 0.2, (2, quality.STATS))
    got = m.scores(np.array([0, 3, 3]), buckets, values, stats)
    for row, entries in ((0, list(zip(buckets, values, strict=True))), (1, [])):
        x = dict(entries) | {quality.BUCKETS + k: v for k, v in enumerate(m.standard(stats)[row])}
        pairs = sum((m.factors[a] @ m.factors[b]) * x[a] * x[b] for a in x for b in x if a < b)
        raw = m.bias + sum(m.weight[a] * v for a, v in x.items()) + pairs
        assert got[row] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_quality_of_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alba", "bero", "cino", "duma"]) for _ in range(30)) + "." if i % 2 else "XX!! " * 30, None) for i in range(80)]
    rows += [(100, None, None), (101, "", 5), (102, "word " * 40_000, None), (None, "no id", 3), (1, rows[1][1], None)]
    docs = docs_of(spark, rows).withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    labels = labels_of(spark, [(i, i % 2, None) for i in range(80)] + [(None, 1, 1), (3, None, None), (200, 1, 0), (5, 1, 0)])
    machine = quality.train(docs, labels)
    got = quality.scored(docs, machine).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 80) >= 79
    kept = quality.accepted(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).select("score").collect()} == {0.5}
    assert quality.scored(docs.limit(0), machine).count() == 0


def test_toxicity_on_held_out_documents(spark):
    found = held_out_errors(spark, "op9_toxicity", "toxic")
    assert (found["predicted"] == found["label"]).mean() > 0.9
    english = table(spark, FOLDER, "documents").where("lang = 'en'").select("doc_id").toPandas()["doc_id"]
    part = found[found["doc_id"].isin(english)]
    assert part[part["label"] == 1]["predicted"].mean() > 0.9


def test_misspellings_within_one_edit():
    words = ["moronic", "stupid", "idiots", "aabbcc"]
    trie = toxicity.Trie()
    for k, w in enumerate(words):
        trie.add(w + "$", 2.0 + k, True)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            rng.choice([lambda k=k: w.__setitem__(k, rng.choice("abcxyz")), lambda k=k: w.insert(k, rng.choice("abcxyz")), lambda k=k: w.pop(k)])()
        word = "".join(w)
        if word:
            want = max((2.0 + k for k, x in enumerate(words) if distance(word, x) <= 1), default=0.0)
            assert trie.near(word) == want, word


def test_misspellings_of_moderate_and_four_letter_terms():
    lexicon = ["vurk", "zolgi", "brantik"]
    trie = toxicity.build_trie([(w + "$", 60, 5) for w in lexicon], 1000, 1000)
    model = toxicity.Model(trie, np.zeros(len(toxicity.FEATURES)), 0.0)
    for word in lexicon:
        assert 1.5 < model.look(word)[0] < 3
        for k in range(len(word)):
            for other in (word[:k] + word[k + 1 :], word[:k] + "#" + word[k + 1 :], word[:k] + "#" + word[k:]):
                assert model.look(other) == (0.0, model.look(word)[0]), other
    assert model.look("vu") == (0.0, 0.0) and model.look("brantik" * 9) == (0.0, 0.0)


def test_quotation_counts_less_than_abuse(spark):
    rng = random.Random(3)
    plain = ["lorem", "ipsum", "dolor", "amet", "elit", "sed", "magna", "erat"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[10] = words[20] = "dreckig"
        rows.append((i, " ".join(words), None))
        labels.append((i, None, int(i % 4 == 0)))
    model = toxicity.train(docs_of(spark, rows), labels_of(spark, labels))
    body = " ".join(plain)
    abuse, misspelt = f"{body} you dreckig {body}", f"{body} you dreckigg {body}"
    quoted = f'{body} they said "you dreckig one" and left {body}'
    assert model.score(abuse) >= 0.3 > model.score(body)
    assert model.look("dreckigg")[1] > 1 or model.look("dreckigg")[0] > 1
    assert model.features(misspelt) != model.features(body)
    assert model.features(quoted)[0] == pytest.approx(toxicity.QUOTED * model.features(abuse)[0])
    odd = docs_of(spark, [(1, None, None), (2, "", None), (None, abuse, None), (3, "dreckig " * 50_000, 1), (3, "dreckig " * 50_000, 1)]).withColumn("score", F.lit(9))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(odd.limit(0), model).count() == 0
    none = toxicity.train(odd, labels_of(spark, []))
    assert {r["score"] for r in toxicity.scored(odd, none).collect()} == {0.5}


def test_language_on_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    got = queries.op4_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_ngrams_and_distance_by_hand():
    codes, counts = langid.ngrams("Ab, ab 1 c")

    def code(s):
        value = 0
        for c in s:
            value = value << 21 | (32 if c == "_" else ord(c))
        return value

    want = {"a": 2, "b": 2, "c": 1, "_a": 2, "ab": 2, "b_": 2, "_c": 1, "c_": 1, "_ab": 2, "ab_": 2, "_c_": 1}
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(k): v for k, v in want.items()}
    first, second = np.array([code("a"), code("b")], np.uint64), np.array([code("b"), code("c")], np.uint64)
    profiles = langid.Profiles({"y": second, "x": first})
    ranked = langid.ngrams("a")[0]
    far = {n: sum(abs(list(p).index(c) - k) if c in p else langid.RANKS for k, c in enumerate(ranked)) for n, p in (("x", first), ("y", second))}
    name, score = profiles.predict("a")
    assert name == "x" and score == pytest.approx(1 - far["x"] / (langid.RANKS * len(ranked)))
    assert profiles.predict("12 !?") == ("und", 0.0) and profiles.predict("") == ("und", 0.0)


def test_language_of_odd_tables(spark):
    rows = [(i, ("der die das und " if i % 2 else "the of and to ") * 20, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "de"), (101, "12345", "en"), (102, "the of and", None), (None, "der die", "de"), (104, "the of " * 30_000, "en"), (1, rows[1][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("code", F.lit(1))
    got = langid.identified(docs, langid.learn(docs)).collect()
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(rows) and by_id[100] == by_id[101] == "und" and by_id[102] == "en" and by_id[104] == "en" and by_id[None] == "de"
    assert langid.identified(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identified(docs.limit(0), langid.learn(docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="post">
<header class="site"><h1>Site name</h1><p>A slogan of the site that is long enough to look like a sentence of text.</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site better, and you accept that by reading on from here.</div>
<div class=content><h2>Real&nbsp;title</h2><p>First &lt;b&gt; paragraph &amp; more,<br>
with <b>bold</b> and <a href="x">one link</a> among its many words, so it is text.<p>Short.</p>
<!-- <p>hidden</p> --><p>The last paragraph ends the article with some more words in it, as it should.</p></div>
<aside><h3>Related</h3><p>Another story with a long teaser that isn't part of this page's article at all.</p></aside>
<form action="/s"><label>Subscribe to our newsletter to get all stories in your inbox every day</label><input><button>Go</button></form>
<div class="comments-area"><p>bob wrote: I liked this article a lot because it was long and had many words in it.</p></div>
<footer>&copy; Site, all rights reserved by the people who made this page some years ago.</footer></body></html>"""


def test_main_text_of_a_page():
    want = ["Real title", "First <b> paragraph & more, with bold and one link among its many words, so it is text.", "Short.",
            "The last paragraph ends the article with some more words in it, as it should."]
    assert htmltext.main_text(PAGE, htmltext.trained()) == "\n\n".join(want)


def test_tree_fits_its_table():
    rows = np.array([[float(x) for x in r.split()] for r in htmltext.LABELLED.strip().replace("\n", "|").split("|")])
    kept = htmltext.trained().keep(rows[:, :-1])
    assert (kept == (rows[:, -1] == 1)).mean() > 0.97


def test_pages_of_the_table_and_odd_ones(spark):
    import html
    import re

    pages = table(spark, FOLDER, "pages")
    got = {r["page_id"]: r["text"] for r in queries.op6_html_extraction(spark, FOLDER).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<< not & html <p"), (4, "u", "<div><script>never closed"), (5, "u", long), (5, "u", long), (None, "u", "</p></div></x>")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = htmltext.extracted(odd).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert sorted(r["n_chars"] for r in found if r["page_id"] == 5) == [249_999, 249_999]
    assert htmltext.extracted(odd.limit(0)).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, v int")


def best(spark, rows, k=5, every=50):
    frame = vectors_of(spark, rows).select("vec_id", covertree.floored(F.col("embedding")).alias("v"), F.lit(1).alias("size"))
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in covertree.top_products(frame, k, every).collect()}


def brute(rows, k=5, every=50):
    usable = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x, *_ in rows
              if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    out = {}
    for q, x in usable.items():
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in usable.items() if i != q and len(y) == len(x))
            out.update({(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored[:k])})
    return out


def test_top_products_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2, 6)).tolist(), None, None) for i in range(600)]
    rows += [(600 + i, rows[3][1], None, None) for i in range(300)]
    rows += [(1000, None, None, None), (1050, [1.0, None, 2.0, 3.0, 4.0, 5.0], None, None), (1100, [float("nan")] * 6, None, None), (1150, [float("inf")] * 6, None, None),
             (None, [1.0] * 6, None, None), (1200, [], None, None), (1250, [1.0, 2.0], None, None), (1251, [3.0, -2.0], None, None), (1300, [0.0] * 6, None, None)]
    monkeypatch.setattr(covertree, "CELL", 64)
    monkeypatch.setattr(covertree, "BLOCK", 8)
    assert best(spark, rows) == brute(rows)


def test_top_products_of_few_rows(spark):
    assert best(spark, []) == {}
    assert best(spark, [(50, [1.0], None, None)]) == {}
    rows = [(0, [1.0, 2.0], None, None), (1, [1.0, 2.0], None, None), (1, [1.0, 2.0], None, None), (2, [-1.0, 0.0], None, None)]
    assert best(spark, rows) == brute(rows)
    assert best(spark, [(1, [1.0], None, None), (2, [1.0], None, None)]) == {}


def test_pruning_skips_far_cells():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 1, (500, 2)) for c in (0, 1000, -1000)]).round()
    queries_ = rng.normal(1000, 1, (20, 2)).round()
    found = covertree.Search(queries_, np.arange(20) + 10_000, points, np.arange(1500), 3, np.full(20, -np.inf))
    want = [sorted((-int(q @ p), i) for i, p in enumerate(points))[:3] for q in queries_]
    assert [[(-int(s), int(i)) for s, i in zip(a, b, strict=True)] for a, b in zip(found.scores, found.found, strict=True)] == want
    assert found.pairs < 20 * 1500 / 2


def test_preference_pairs_equal_sql(spark, tmp_path):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "hi"), (0, 2, "assistant", "a"), (0, 3, "user", "more"), (0, 4, "assistant", "bé\n"), (0, 5, "user", "end"),
            (1, 0, "user", "hi"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, "user", None), (3, 0, None, "t"), (3, None, "assistant", "first"),
            (4, 0, "user", "same"), (4, 1, "assistant", "same"), (5, 7, "user", "q"), (5, 9, "assistant", "same"), (8, 0, "assistant", "only"), (None, 0, "user", "no")]
    rows += [(11, t, "user" if t % 2 else "assistant", "w " * 5000) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("prompt", F.lit("x"))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op10_chat_formatting(spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.execute(preference.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].equals(want[sorted(got)])
    by_id = got.set_index("conv_id")
    assert by_id.loc[0, "prompt_turns"] == 4 and by_id.loc[0, "chosen"] == "<|im_start|>assistant\nbé\n<|im_end|>\n" and by_id.loc[0, "chosen_spans"] == "22:36"
    assert by_id.loc[0, "rejected"].endswith("\nx<|im_end|>\n")
    assert by_id.loc[4, "chosen"] == by_id.loc[4, "rejected"] == ""
    assert by_id.loc[8, "rejected"] == "" and by_id.loc[8, "prompt"] == ""
    assert queries.preference.formatted(preference.exchanged_replies(frame.limit(0)), "conv_id").count() == 0
    nulls = spark.createDataFrame([(1,)], "k long").select("k", F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>").alias("chosen")).withColumn("rejected", F.col("chosen"))
    assert preference.formatted(nulls, "k").head()["prompt"] == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    with duckdb.connect() as con:
        for t in ("embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
    columns = sorted(got)
    assert sorted(want) == columns
    assert got[columns].sort_values(columns).reset_index(drop=True).equals(want[columns].sort_values(columns).reset_index(drop=True))


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, [docs.count()]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, FOLDER)
        path = os.path.join(str(tmp_path), str(k))
        out.write.parquet(path)
        before = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert before.columns == columns
            ids.append(before.count())
    assert ids == sorted(ids, reverse=True) and ids[1] < ids[0] and ids[2] < ids[1] and ids[4] < ids[3] and ids[3] == ids[2]
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert before.select("doc_id").distinct().count() == ids[-1]
    whole = corpus_pipeline.run(spark, FOLDER)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole.select(same).exceptAll(before.select(same)).count() == 0


def test_every_language_gets_a_profile(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676)} " * 20, f"l{i:04}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["lang"] for r in docs.where(fold(F.col("doc_id"), 4) != 2).select("lang").collect()}
    profiles = langid.learn(docs)
    assert set(profiles.names) == kept and len(kept) > 1000
    few = langid.learn(docs.where("doc_id < 8").unionByName(docs.where("doc_id < 8")), most=1)
    assert len(few.names) == docs.where("doc_id < 8").where(fold(F.col("doc_id"), 4) != 2).count()
