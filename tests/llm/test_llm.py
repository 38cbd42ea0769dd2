"""The training-data operators on small cases: nulls, empty and long texts, ties, repeated rows, empty
tables, clashing column names; and each against brute force."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenscan.llm import audio, bpe, common, components, exact_dedup, fuse, html_main, jaccard, langid, licences, mixing, quality, records, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, base = [], words(rng, 60, 10_000)
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 80)), "en", f"s{i % 4}", 0))
    for i in range(60, 80):  # near copies of one text, at several distances
        own = base.split()
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(own), None, "s0", 0))
    rows += [(80, None, None, None, None), (81, "", "en", None, 0), (82, " \n\t", "en", "s1", 0), (83, "One  two", "en", "s1", 0), (84, "one two", "en", "s2", 0), (85, "One two", "en", "s2", 0)]
    rows += [(86, "same id a b c d e f", "en", "s1", 0), (86, "other text under one id x y z", "en", "s1", 0), (87, "twice the same row u v w", "en", "s3", 0), (87, "twice the same row u v w", "en", "s3", 0)]
    rows += [(None, "a null id here k l m n", "en", "s3", 0), (88, words(rng, 30_000, 50_000), "en", "s3", 0), (89, "Á é x\x0by Ünïcode 中文。 😀", "fr", "sé", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns under names that the operators use themselves."""
    names = ["h", "size", "shards", "mix_shard", "token_ids", "decoded", "digest", "v", "n", "h_id", "quality_score", "lang_pred", "licences", "m_h", "c0", "gone_id"]
    return docs.select("*", *[F.lit(1).alias(x) for x in names])


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# -- mixing --------------------------------------------------------------------------------

def test_targets_are_capped_and_shared():
    assert mixing.targets([100, 100, 800], [5, 2, 1], 3) == [300.0, 300.0, 400.0]
    assert sum(mixing.targets([10, 1000, 5, 50], [5, 2, 1, 5], 3)) == pytest.approx(1065)
    assert mixing.targets([0, 0], [5, 2], 3) == [0.0, 0.0]
    assert mixing.targets([], [], 3) == []


def test_split_tree_keeps_quotas():
    quota = np.array([7, 0, 30, 101])
    rng = np.random.Generator(np.random.PCG64(1))
    dealt = np.zeros((10, 4), int)
    for row, (sources, counts) in zip(dealt, mixing.split_tree(quota, 10, rng), strict=True):
        row[sources] = counts
    assert (dealt.sum(0) == quota).all() and np.ptp(dealt.sum(1)) <= 1


def test_mix(docs, corpus, clashing):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(corpus)
    own, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= len(r.shards) <= 3
        own[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.shards)
        target[r.source] = r.target
    expect = defaultdict(int)
    for _, t, _, s, _ in corpus:
        expect[s] += size(t)
    assert own == expect
    names = sorted(s for s in own if s is not None) + [None]
    assert [target[s] for s in names] == pytest.approx(mixing.targets([own[s] for s in names], [5, 2, 1, 5, 2, 1][: len(names)], 3))
    mixed = mixing.mix(docs).collect()
    count = defaultdict(int)
    for r in mixed:
        count[r.source] += size(r.text)
    assert count == {s: n for s, n in taken.items() if n or s in count}
    again = mixing.plan_mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(clashing).columns == [*clashing.columns, "_mix_shard", "mix_order"]
    many = mixing.mix(docs, mixing.Mixer(shard_words=500, block_words=100))  # shards follow the size
    assert many.select("mix_shard").distinct().count() > 10 and many.groupBy("doc_id", "text").count().filter("count > 6").isEmpty()
    assert mixing.plan_mix(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, words(rng, rng.randrange(1, 200)), None, f"s{i % 3}", 0) for i in range(600)], SCHEMA)
    got = mixing.plan_mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.size("shards")).alias("k")).collect()
    assert all(abs(r.t - r.k) <= 25 for r in got)  # of texts up to 199 words


# -- licences ------------------------------------------------------------------------------

def test_licences(spark, docs):
    texts = [None, "", "The MIT License and the mit  license; APACHE LICENSE", "Licensed under the Apache License, Version 2.0.", "GNU General Public-License, version 3", "mit", "Lizenz: Licensed under CC BY-NC 4.0", "mit license " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.licences for r in licences.scan(d, licences.build_index(d)).collect()}
    assert out[0].n_words == 0 and not out[0].places
    assert [(p.label, p.start) for p in out[2].places] == [("mit", 1), ("mit", 5), ("apache", 7)] or {(p.label, p.start) for p in out[2].places} == {("mit", 1), ("mit", 5), ("apache", 7)}
    assert {n.label for n in out[3].notices} == {"apache-2.0"}
    assert {p.label for p in out[4].places} == {"gpl"}
    assert not out[5].places and {n.label for n in out[6].notices} == {"cc-by-nc-4.0"}
    assert len(out[7].places) == 3000
    assert licences.scan(docs, licences.build_index(docs)).count() == docs.count()


def test_licences_against_brute_force(spark):
    """Base places of random texts of licence words, phrases and others, by plain search."""
    rng = random.Random(21)
    pieces = ["mit", "MIT", "license", "License,", "apache", "general", "public", "licence", "GNU", "é", "x", "mit license", "apache\nlicense", "General-Public  License"]
    texts = [None, "", *(" ".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300))]
    texts += texts[:20]  # repeated rows
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(d, licences.build_index(d)).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = {(label, k) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()}
        assert got[i].n_words == len(ws) and {(p.label, p.start) for p in got[i].places} == want and len(got[i].places) == len(want)


def test_licence_candidates(spark, empty, clashing):
    index = licences.Index(licences.PHRASES + licences.NOTICES + licences.TEXTS, {b"the": 90, b"of": 90}, 100)
    bsd = next(t for t in licences.TEXTS if t.label == "bsd")
    n = next(k for k, t in enumerate(index.templates) if t is bsd)
    # Key words far apart pass the gate; one shared word at a place agrees with nothing.
    far = " x ".join(w.decode() for key in index.keys[n] for w in key).encode().split()
    assert index.scan([b"merchantability", *[b"y"] * 400], 0.75) == []
    here = {w: np.array([k * 900]) for k, w in enumerate(index.order[n][:1])}
    assert index.alignments(n, index.order[n][:1], here) == []
    assert not [m for m in index.scan(far, 0.75) if m[0] == n]
    words_ = licences.words_of(bsd.text)
    rng = random.Random(3)
    for change in range(4):
        own = list(words_)
        if change == 1:  # reflowed, with marks in other places
            own = licences.words_of(" ".join(f"* {w.decode()},\n" if k % 7 == 0 else w.decode() for k, w in enumerate(own)))
        elif change == 2:  # words lost and put in
            for _ in range(6):
                del own[rng.randrange(70, len(own))]
                own.insert(rng.randrange(70, len(own)), b"zzz")
        elif change == 3:  # two copies and text around
            own = [b"a"] * 30 + own + [b"b"] * 50 + own
        found = [m for m in index.scan(own, 0.75) if m[0] == n]
        assert len(found) == (2 if change == 3 else 1) and all(m[2] >= 0.75 for m in found), change
    assert licences.scan(empty, licences.build_index(empty)).count() == 0
    kept = licences.scan(clashing, licences.build_index(clashing))
    assert kept.columns == [*clashing.columns, "_licences"]


# -- classifiers ---------------------------------------------------------------------------

def junk(rng):
    return " ".join(f"W{rng.randrange(9)}###" for _ in range(rng.randrange(5, 90)))


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 5 == 0 else words(rng, rng.randrange(5, 90)), None, None, 0) for i in range(400)]
    d, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    scored = quality.score(d, quality.model_of(d, labels)).collect()
    right = [(r.quality_score >= 0.5) == (r.doc_id % 5 > 0) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    model = quality.model_of(d, labels)
    some = quality.score(docs, model)
    assert some.filter("quality_score between 0 and 1").count() == docs.count()
    assert quality.score(empty, model).count() == 0
    assert quality.model_of(d, labels.filter("false")) is None
    assert {r.quality_score for r in quality.score(docs, None).collect()} == {0.5}
    odd = {r.doc_id: r.quality_score for r in some.collect()}
    assert odd[80] == odd[81]  # null counts as empty
    assert quality.score(docs.withColumn("quality_score", F.lit(1)), model).columns[-1] == "_quality_score"
    # The scores are those of the network's plain arithmetic; labels of 0, repeats and null ids change nothing.
    x = (quality.features("some words of a text") - model.mean) / model.scale
    w1, b1, w2, b2 = model.layers
    plain = 1 / (1 + np.exp(-(np.tanh(np.clip(x, -6, 6) @ w1 + b1) @ w2 + b2)))
    assert model.scores(quality.features("some words of a text")[None, :])[0] == pytest.approx(plain[0] if np.ndim(plain) else plain)
    more = labels.filter("quality = 1").unionByName(labels.filter("quality = 1")).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))
    assert all(np.allclose(a, b) for a, b in zip(quality.model_of(d, more).layers, model.layers, strict=True))


def test_class_prior():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.9):
        n = 4000
        good, bad = rng.normal(0, 1, (n, 4)), rng.normal(2.5, 1, (n, 4))
        u = np.concatenate([good[: int(n * share)], bad[: int(n * (1 - share))]])
        assert abs(quality.class_prior(rng.normal(0, 1, (2000, 4)), u) - share) < 0.08


def test_language(spark, docs, empty):
    rng = random.Random(3)
    sound = {"en": ["the", "and", "ing", "tion"], "de": ["der", "und", "sch", "ung"], "fr": ["les", "eau", "ou", "est"], "es": ["los", "ción", "que", "ado"]}
    rows = [(i, " ".join(rng.choice(sound[x]) + rng.choice("aeiou") for _ in range(rng.randrange(3, 40))), x, None, 0) for i, x in enumerate(list(sound) * 60)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(d, learn=common.fold("doc_id", 4) != 2)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and len(model.pairs) == 3
    out = langid.predict(d.filter(common.fold("doc_id", 4) == 2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs, model).collect()}
    assert odd[80] == odd[81] == odd[82] == ("und", 0.0)
    assert langid.predict(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0


def test_language_against_plain_arithmetic(spark, clashing):
    """Predictions by dense vectors and plain votes; ties, repeats, a dirty column and a clash of names."""
    rng = np.random.default_rng(12)
    langs = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "xx": ["xx"]}
    pairs = [(None, a, b) for i, a in enumerate(sorted(langs)) for b in sorted(langs)[i + 1 :]] + [(f, a, b) for f, own in langs.items() for i, a in enumerate(own) for b in own[i + 1 :]]
    m = langid.Model(langs, pairs, rng.normal(size=(langid.DIMS, len(pairs))), rng.normal(size=len(pairs)) * 0.01)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gämma", "12"], rng.integers(0, 30))) for _ in range(80)]
    texts += texts[:9]

    def vote(x, node, names):
        votes, soft = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for k, (own, a, b) in enumerate(pairs):
            if own == node:
                p = 1 / (1 + np.exp(-4 * (x @ m.weights[:, k] + m.bias[k])))
                votes[a if p > 0.5 else b] += 1
                soft[a] += p
                soft[b] += 1 - p
        return max(names, key=lambda n: (votes[n] + soft[n] / (len(names) + 1), -names.index(n)))

    got, score = m.predict(texts)
    for t, lang in zip(texts, got, strict=True):
        x = langid.shares(t).astype(np.float64)
        family = vote(x, None, sorted(langs))
        assert lang == vote(x, family, langs[family])
    assert got[:9] == got[80:] and ((score >= 0) & (score <= 1)).all()
    rows = [(i, f"{x} {x}a {x}b", x, None, 0) for i, x in enumerate(["en", "de", "fr"] * 20 + [f"bad{k}" for k in range(30)])]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert sorted(x for own in model.families.values() for x in own) == sorted({r[2] for r in rows})
    assert langid.predict(clashing, model).columns == [*clashing.columns, "_lang_pred", "lang_score"]


def test_margins_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(0)
    m = langid.Model({"a": ["x"], "b": ["y"]}, [(None, "a", "b")], rng.normal(size=(langid.DIMS, 1)), np.zeros(1))
    texts = ["some words here", "other", "", "and a longer text than before " * 5]
    both = m.margins(texts)
    alone = np.concatenate([m.margins([t]) for t in texts])
    assert np.allclose(both, alone)


# -- pages ---------------------------------------------------------------------------------

PAGE = "<html><head><title>{t}</title></head><body><div><p>Our site in brief</p><a href=/>Home</a></div><div><h1>{t}</h1><p>{x} &amp; more<br>line <b>bo</b>ld</p></div><script>if (a < b) x('</p>')</script></body></html>"


def test_site_templates(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(t=f"Title {i}", x=f"text {i}")) for i in range(8)]
    rows += [(8, "http://b.example.com/8", PAGE.format(t="Alone", x="one")), (9, None, None), (10, "x", ""), (11, "http://a.example.com/11", "<p>broken <b>tags<p>&#233;&nbsp;x</i>")]
    out = {r.page_id: r.main_text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3 text 3 & more line bold"
    assert out[8].startswith("Our site in brief Home Alone one")
    assert out[9] == out[10] == "" and out[11] == "broken tags é x"


def test_articles_and_marks():
    x = "<header>top</header><div class='cookie-notice'>c</div><main><article><header><h1>T</h1></header><p>a<ul><li>b<li>c</ul><form>f</form><div class='ad-slot'>no</div></article><section id=comments><p>hi</p></section></main><footer>z</footer>"
    assert html_main.main_text(x) == "T a b c"
    copies = [f"<title>same</title><article><p>{k}</p><p>shared words</p></article>" for k in range(9)]
    assert all("shared words" in html_main.main_text(c, frozenset({1})) for c in copies)
    assert html_main.main_text("<div>" * 5000 + "deep") == "deep"


def test_self_closed_svg_and_math():
    for cut in ("<svg/>", "<svg width='1' />", "<math/>", "<svg hidden/>", "<svg width=1>", "<svg><path d='M0'/></svg>", "<svg width='1'/><svg><text>no</text></svg>"):
        assert html_main.main_text(f"<article><p>before</p>{cut}<p>after</p></article>") == "before after", cut
    assert html_main.main_text("<p>a</p><svg href=x/><text>no</text></svg><p>b</p>") == "a b"


def test_names_do_not_delete_articles():
    text = html_main.main_text
    assert text("<div class='site has-sidebar'><main><p>whole article</p></main><div class=sidebar>no</div></div>") == "whole article"
    assert text("<div class='content with-sidebar'><p>text</p></div><div class=ad>no</div>") == "text"
    assert text("<article><div class='entry-header'><h1>T</h1></div><p>a</p></article>") == "T a"
    assert text("<div class='page-header'><article><p>long enough</p></article></div><div class=related><article>x</article></div>") == "long enough"
    assert text("<div class='widget'><p>most of the text</p><div class=share>no</div></div><p>rest</p>") == "most of the text rest"
    assert text("<article><p>a</p></article><section id=comments><article class=comment><p>far more text than in the article</p></article></section>") == "a"
    assert text("<div class=notice>x</div><div class=alert>y</div>") == "x y"
    assert text("<div hidden><main>no</main></div><p>a</p>") == "a"


def test_names_inside_articles():
    text = html_main.main_text
    long = "words of the article itself " * 20
    for inner in ("<p class='header'>kept</p>", "<div class='social history'>kept</div>", "<section id='share'><p>kept</p></section>", "<label>kept</label>", "<math><mi>kept</mi></math>", "<h2 class=notice>kept</h2>", "<ul class=toc-notes><li>kept</ul>"):
        assert text(f"<article><h1>T</h1><p>{long}</p>{inner}</article>").endswith("itself kept"), inner
    for inner in ("<div class='ad'>no</div>", "<div class='share-bar'><a href=x>no</a> <a href=y>no</a></div>", "<ul class=related><li>no</ul>", "<section class='reader comments'><p>no</p></section>", "<math><annotation>no</annotation></math>"):
        assert text(f"<article><h1>T</h1><p>{long}</p>{inner}</article>").endswith("itself"), inner


FURNITURE = "<div><b>Home</b> | <b>News</b></div><section><span>Weather today</span></section>{x}<div><p>All rights reserved, imprint</p></div>"


def test_neutral_furniture_goes_by_counts_alone(spark, empty, clashing):
    """No tag or name tells it: with templates it is gone, without them it stays. Subtrees are counted again by hand."""
    rng = random.Random(31)
    rows = [(k, f"http://n.example.com/{k}", FURNITURE.format(x=f"<div><h2>Head {k}</h2><p>{words(rng, 40, 5000)}</p></div>")) for k in range(12)]
    rows += [(k, f"http://few.example.com/{k}", FURNITURE.format(x=f"<div><p>{words(rng, 40, 5000)}</p></div>")) for k in range(20, 24)]  # under five pages
    rows += [(40, "http://n.example.com/0", rows[0][2]), (41, "http://n.example.com/long", FURNITURE.format(x=f"<div><p>{words(rng, 60_000, 5000)}</p></div>"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.main_text for r in html_main.extract(d).collect()}
    for k, _, html in rows:
        plain = html_main.main_text(html)
        assert plain.startswith("Home | News Weather today") and plain.endswith("imprint")
        assert out[k] == (plain if 20 <= k < 24 else plain.removeprefix("Home | News Weather today ").removesuffix(" All rights reserved, imprint")), k
    count = defaultdict(set)  # brute force over the marks: host and subtree -> contents
    for _, url, html in rows:
        for mark in html_main.shown(html_main.parse(html)):
            count[url.split("/")[2], mark].add(html)
    expect = defaultdict(set)
    for (site, mark), pages in count.items():
        if len(pages) >= html_main.MIN_PAGES:
            for html in pages:
                expect[html].add((mark, len(pages)))
    keys = d.select(F.xxhash64(html_main.host(), "html").alias("page"), F.xxhash64(html_main.host()).alias("site"), "html").distinct().collect()
    got = {r.page: {(m.tree, m.n) for m in r.marks} for r in html_main.site_templates(d).collect()}
    assert {r.html: {(t ^ r.site, n) for t, n in got.get(r.page, set())} for r in keys if r.page in got} == dict(expect)
    one = html_main.extract(d.withColumn("main_text", F.lit(1)).withColumn("page_marks", F.lit(2)))
    assert one.columns[:5] == ["page_id", "url", "html", "main_text", "page_marks"] and one.columns[5] == "_main_text"
    assert html_main.extract(d.limit(0)).count() == 0


def test_templates_of_constant_titles_and_large_hosts(spark):
    # One title and h1 on all pages, and a box on 6 of 100 pages.
    page = "<title>same</title><div><h1>same</h1></div><div><p>menu</p></div>{box}<div><p>text {k}</p></div>"
    rows = [(k, f"http://big.example.com/{k}", page.format(k=k, box="<div><b>box</b></div>" if k < 6 else "")) for k in range(100)]
    rows += [(k, "http://big.example.com/again", page.format(k=0, box="<section>one page only</section>")) for k in range(100, 110)]  # one content counts once
    out = {r.page_id: r.main_text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"text {k}" for k in range(100)) and len(out) == 110
    assert out[105] == "one page only text 0"


def test_counts_decide_inside_and_outside_articles(spark):
    def extract(pages):
        rows = [(k, f"http://h.example.com/{k}", p) for k, p in enumerate(pages)]
        return [r.main_text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]

    own = [f"own text {k} of some length" for k in range(48)]
    plain = [f"<div><div>menu</div><div>{x}</div><article><p>teaser {x[:10]}</p></article></div>" for x in own[:8]]
    notice = [f"<main><article><h1>T {k}</h1><p>Read our terms.</p><p>{x}</p></article></main>" for k, x in enumerate(own[8:40])]
    shared = "".join(f"<p>paragraph {k} of an article that was copied</p>" for k in range(4))  # near copies: one paragraph differs
    copies = [f"<article><p>Read our terms.</p>{shared}<ul><li>a list</ul><p>{x}</p></article>" for x in own[40:]]
    rng = random.Random(9)
    base = words(rng, 300, 5000).split()  # one article, many words changed; heading and opening are the same
    edits = [" ".join(f"x{rng.randrange(9999)}" if rng.random() < 0.08 else w for w in base) for _ in range(12)]
    series = [f"<article><h1>Series</h1><p>The opening.</p><p>{x}</p><p>Read our terms.</p></article>" for x in edits]
    got = extract(plain + notice + copies + series)
    assert got[48:] == [f"Series The opening. {x}" for x in edits]
    got = got[:48]
    assert got[:8] == [f"{x} teaser {x[:10]}" for x in own[:8]]
    assert got[8:40] == [f"T {k} {x}" for k, x in enumerate(own[8:40])]
    assert got[40:] == [f"{' '.join(f'paragraph {k} of an article that was copied' for k in range(4))} a list {x}" for x in own[40:]]


# -- exact duplicates ----------------------------------------------------------------------

def test_fuse_filter():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 50, 3000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.build(np.concatenate([keys, keys]))
        assert fuse.contains(f, keys).all()
        assert fuse.contains(f, rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01


def brute_exact(corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_exact_dedup(spark, docs, corpus, empty, clashing, monkeypatch):
    groups = brute_exact(corpus)
    rows = exact_dedup.decide(docs).rows.collect()
    assert sum(r.n for r in rows) == len(corpus)
    want = {(i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == want
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)
    assert exact_dedup.decide(empty).rows.count() == 0
    few = exact_dedup.build_snapshot(spark.createDataFrame([(1, bytes(32), 1)], "doc_id long, digest binary, n long"))
    batch = spark.createDataFrame([(bytes([k]) * 32, k, 1) for k in range(200)], "digest binary, keep_id long, n long")
    monkeypatch.setattr(exact_dedup, "GROUPS", 20)  # a batch of ten times the snapshot's bucket
    assert [r.keep_id for r in exact_dedup.screen(batch, few).filter("keep_id = 0").collect()] == [0]
    assert exact_dedup.screen(batch, few).count() < 20
    # A cut that gives the snapshot the larger ids changes nothing.
    other = exact_dedup.decide(docs, split_id=1).rows.collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in other} == want


def test_texts_under_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda c="text": F.unhex(F.sha2(F.substring(common.normalised(c), 1, 1).cast("binary"), 256)))
    d = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.decide(d).rows.collect()}
    assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}


# -- near duplicates -----------------------------------------------------------------------

def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in members[root(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def test_shingle_sets_match_words(corpus):
    texts = [t for _, t, *_ in corpus]
    assert [len(s) for s in shingles.sets(texts)] == [len(shingle_set(t)) for t in texts]


def test_jaccard_join(docs, corpus, empty, clashing):
    rows, links = jaccard.join_classes(docs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()), key=str)
    assert got == brute_classes([(i, t) for i, t, *_ in corpus])
    assert links.count() > 0
    assert jaccard.join_classes(empty)[0].count() == 0
    assert jaccard.keep_one(clashing).columns == clashing.columns


@pytest.mark.parametrize(("seed", "rounds", "cut"), [(1, 1, 3), (2, 1, 3), (3, 2, 3), (4, 1, 12), (5, 3, 12)])
def test_jaccard_join_near_the_threshold(spark, monkeypatch, seed, rounds, cut):
    """Chains of texts around the threshold, of like or of different sizes: lists fall into several classes, so every step is used."""
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    monkeypatch.setattr(jaccard, "PART", 200)
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        own = [f"g{g}w{k}" for k in range(rng.randrange(20, 60))]
        for _ in range(18):
            if rng.random() < 0.8:
                own = list(own)
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                own = own[rng.randrange(cut) :] if len(own) > cut else own
            rows.append((len(rows), " ".join(own)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(d, rounds=rounds)[0].collect()), key=str)
    assert got == brute_classes(rows)


@pytest.mark.parametrize("bits", [48, 9])
def test_jaccard_join_writes_entries_once(spark, monkeypatch, bits):
    """Entries go to their parts in 16 bytes and lie in no table of their own; shingles of equal bits change no class."""
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    monkeypatch.setattr(jaccard, "PART", 200)
    monkeypatch.setattr(jaccard, "TOKEN", bits, raising=False)
    written, plain = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append((name, df.dtypes)) or plain(df, name))
    rng, rows = random.Random(11), []
    for g in range(8):
        own = words(rng, 60, 3000).split()
        for _ in range(10):
            own = list(own)
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(d)[0].collect()), key=str)
    assert got == brute_classes(rows)
    binary = {name for name, types in written if "binary" in dict(types).values()}
    assert binary <= {"join-sets", "join-compared"}  # the sketch, differences from hubs


def test_equal_first_words_of_digests(spark, monkeypatch):
    """Sets whose identities share their first 64 bits are told apart by the second."""
    plain = jaccard._identity
    few = lambda s: (plain(s)[0] % 3, plain(s)[1])
    monkeypatch.setattr(jaccard, "_identity", few)
    monkeypatch.setattr(jaccard, "_name", lambda s, clashing: few(s)[1] if few(s)[0] in clashing else few(s)[0])  # workers get these with the closures
    rng = random.Random(5)
    base = [words(rng, 30, 3000) for _ in range(12)]
    rows = list(enumerate(base + [b + " tail" for b in base]))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()), key=str)
    assert got == brute_classes(rows)


def test_overlaps_from_differences():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    hub = pool[:200]
    sets_ = [np.unique(np.concatenate([rng.permutation(hub)[:150], rng.permutation(pool)[:40]])) for _ in range(2)]
    less, more = [[np.setdiff1d(hub, s).tobytes() for s in sets_], [np.setdiff1d(s, hub).tobytes() for s in sets_]]
    b = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "na": [len(sets_[0])], "nb": [len(sets_[1])], "nh": [len(hub)], "less_a": [less[0]], "less_b": [less[1]], "more_a": [more[0]], "more_b": [more[1]]})
    assert next(jaccard._derive(iter([b]))).column("common").to_pylist() == [len(np.intersect1d(*sets_))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}


# -- tokens --------------------------------------------------------------------------------

PIECES = ["a", "the", "'s", "'re", " ", "  ", "\n", "\t", "1", ".", "é", "中", "。", "😀", "_", " ", "\x85", "<|endoftext|>"]


def test_tree_encoding_is_the_plain_one():
    c, rng = bpe.TreeCodec(bpe.default_path()), random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        c.leaf = rng.choice([1, 2, 3, 8])
        ids = c.encode(t)
        assert ids == c.span_ids(t) and c.decode(ids) == t.encode()


def test_encode_and_decode(docs, corpus, empty, clashing):
    out = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, *_ in corpus)
    assert bpe.encode(clashing).columns[-1] == "_token_ids" and bpe.encode(empty).count() == 0
    r = bpe.digests(docs).filter("doc_id = 83").first()
    assert r.decoded_sha256 == hashlib.sha256(b"One  two").hexdigest()


def test_word_encoder_is_the_plain_one():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(records.VOCABULARY)
    plain = Tokenizer.from_file(path)  # as it is: an added token's string gives its id
    own, rng = records.WordEncoder(path, 2, known=600), random.Random(7)
    for _ in range(60):
        texts = ["".join(rng.choice([*PIECES, "word", "Word"]) for _ in range(rng.randrange(30))) for _ in range(40)]
        for t, raw in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(raw, dtype=own.dtype).tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]
    end = "<|endoftext|>"
    texts = [end, end + " b", "a " + end, f"a {end} b", end + end, f"word{end}word and {end}\n", "<|endoftext| >", "plain words."]
    for t, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, dtype=own.dtype).tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]
    assert 50256 in np.frombuffer(own.encode([f"a {end} b"])[0], dtype=own.dtype)


def test_word_encoder_bounds_what_it_holds(tmp_path):
    """Words that never come again are given up, those that do stay; a worker that reads files holds none."""
    import public_tokenizers

    own = records.WordEncoder(public_tokenizers.path(records.VOCABULARY), 2)
    for k in range(10):
        own.encode(["start common words " + " ".join(f"k{k}w{i}" for i in range(100_000))])
        assert sum(len(x) for x in vars(own).values() if isinstance(x, dict)) <= 801_000
    assert {"common", "words"} <= own.ids.keys() and "k0w5" not in own.ids
    own = records.word_encoder(public_tokenizers.path(records.VOCABULARY), 2)
    own.encode(["start common words"])
    assert own.ids and list(records._reader(f"file://{tmp_path}")(iter([]))) == [] and not own.ids


def crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c = (c >> 8) ^ int(records.TABLES[0][(c ^ x) & 255])
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert crc(b"123456789") == 0xE3069283
    rng = random.Random(8)
    data = [rng.randbytes(2 * rng.randrange(0, 400)) for _ in range(50)] + [b""]
    assert (records.payload_crc(data) == records.masked(np.array([crc(x) for x in data], dtype=np.uint32))).all()


def test_records(spark, docs, corpus, empty, tmp_path):
    import tiktoken  # noqa: F401
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(records.VOCABULARY))
    folder = f"file://{tmp_path}/a"
    index = records.write_records(docs, folder, files=3)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in records.read_records(index, folder).collect()))
    assert [i is not None for _, i, _ in got] == [False] + [True] * (len(corpus) - 1)
    assert [i for _, i, _ in got][1:] == sorted(i for i, *_ in corpus if i is not None)
    assert sorted(x for _, _, x in got) == sorted([*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in corpus)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)
    one = records.read_records(index.filter("doc_id = 88").repartition(2), folder).first()
    assert len(one.ids) > 10_000
    part = next(tmp_path.glob("a/part-*.tfrecord"))
    broken = bytearray(part.read_bytes())
    broken[14] ^= 1
    part.write_bytes(broken)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(index, folder).collect()
    assert records.write_records(empty, f"file://{tmp_path}/b").count() == 0


# -- sound ---------------------------------------------------------------------------------

def test_shifted_recordings_align(spark):
    rng = np.random.default_rng(1)

    def tune(n):
        return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * np.arange(2700) / audio.RATE) for k in rng.integers(0, 24, n)])

    a, other = tune(60), tune(60)
    rows = [(0, a.tolist()), (1, (a[audio.HOP * 20 :] + 0.02 * rng.normal(size=len(a) - audio.HOP * 20)).tolist()), (2, other.tolist()), (20, a.tolist()), (3, None), (4, [0.0] * 100)]
    d = spark.createDataFrame(rows, "rec_id long, samples array<double>")
    out = {r.rec_id: r for r in audio.align(audio.fingerprint(d, "samples"), F.col("rec_id") % 20 == 0).collect()}
    assert len(out) == 6 and out[20].class_id == 0
    assert (out[0].match_id, out[0].offset) == (1, -20) and out[0].bit_error < 0.1
    assert out[3].n_codes == out[4].n_codes == 0 and out[3].match_id is None


def wav(samples, rate=audio.RATE, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        x = np.repeat(np.round(samples * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels) + (128 if width == 1 else 0)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in x))
    return out.getvalue()


def test_wav_columns(spark, empty):
    rng = np.random.default_rng(5)
    t = 0.5 * np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * np.arange(2700) / audio.RATE) for k in rng.integers(0, 24, 30)])
    for width, channels in ((1, 1), (2, 1), (2, 2), (3, 1), (4, 2)):
        got = audio.wav_samples(wav(t, width=width, channels=channels))
        assert len(got) == len(t) and np.abs(got - t).max() < 0.02
    assert len(audio.wav_samples(wav(t, rate=2 * audio.RATE))) == -(-len(t) // 2)  # another rate
    rows = [(0, wav(t)), (1, wav(t[audio.HOP * 5 :], width=3)), (2, None), (3, b"RIFF broken"), (4, b""), (5, wav(t)), (5, wav(t)), (None, wav(t[:50]))]
    d = spark.createDataFrame(rows, "rec_id long, sound binary").withColumn("codes", F.lit("taken"))
    prints = audio.fingerprint(d, "sound", to_frames=audio.wav_chroma)
    assert prints.columns == ["rec_id", "sound", "codes", "_codes"]
    out = audio.align(prints.drop("codes"), F.col("rec_id") == 0, codes_col="_codes").collect()
    by = {r.rec_id: r for r in out}
    assert len(out) == 8 and by[0].match_id == 1 and by[0].offset == -5 and by[5].class_id == 0
    assert by[2].n_codes == by[3].n_codes == by[4].n_codes == by[None].n_codes == 0
    none = audio.fingerprint(empty.select(F.col("doc_id").alias("rec_id"), F.lit(None).cast("binary").alias("sound")), "sound", to_frames=audio.wav_chroma)
    assert audio.align(none, F.col("rec_id") == 0).count() == 0


def test_alignment_recall():
    """Of recordings heard again with noise, nearly all share an integer with the original: the search reaches them."""
    rng = np.random.default_rng(8)
    reached = 0
    for _ in range(40):
        frames = np.repeat(np.maximum(0, rng.normal(size=(20, 12))), 4, axis=0)
        noisy = np.maximum(0, frames + 0.15 * rng.normal(size=frames.shape))[rng.integers(0, 12) :]
        a, b = audio.codes(audio.unit(frames)), audio.codes(audio.unit(noisy))
        best = min(audio.bit_error(a, b, o)[0] for o in range(0, 13))
        assert best < 0.35
        reached += bool(set(a.tolist()) & set(b.tolist()))
    assert reached >= 36


def test_audio_alignment_is_whole(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(-(2**31), 2**31, n)
    true = noise(300)
    near = true ^ np.where(rng.random(300) < 0.3, 1, 0)  # one bit of 32 in three of ten positions
    loop = np.tile(noise(5), 12)  # repeats: many offsets with as many votes
    far = np.concatenate([noise(40), loop[:20], noise(3)])
    steady = [7] * 40
    rows = [(0, true), (1, near), (2, np.concatenate([noise(50), true[:4]])), (20, loop), (3, far), (40, steady), (4, [7] * 25), (60, noise(30)), (80, np.array([5, 6] * 10)), (5, np.array([6, 5] * 8))]
    codes = {k: np.asarray(c, dtype=np.int32).view(np.uint32) for k, c in rows}
    d = spark.createDataFrame([(k, [int(x) for x in np.asarray(c)]) for k, c in rows], "rec_id long, codes array<int>")
    got = {r.rec_id: r for r in audio.align(d, F.col("rec_id") % 20 == 0).collect()}
    for a in (0, 20, 40, 60, 80):  # brute force over every offset of every pair
        best = None
        for b in codes:
            for o in range(1 - len(codes[a]), len(codes[b])) if b != a else ():
                lo, hi = max(0, -o), min(len(codes[a]), len(codes[b]) - o)
                if (codes[b][lo + o : hi + o] == codes[a][lo:hi]).any():
                    e, n = audio.bit_error(codes[b], codes[a], o)
                    rank = (-round(32 * n * (1 - 2 * e)), e, b, o)
                    best = min(best or rank, rank)
        assert (got[a].match_id, got[a].offset) == ((best[2], best[3]) if best else (None, None)), a
    assert got[0].match_id == 1 and got[40].match_id == 4 and got[60].match_id is None


def test_oracle_is_sql():
    from lumenscan.llm import queries

    assert queries.ORACLE_SQL and all(isinstance(q, str) for q in queries.ORACLE_SQL.values())


# -- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, corpus):
    import corpus_pipeline

    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    exact = by["exact_dedup"](spark, docs, "")
    assert exact.columns == docs.columns and exact.count() == len(brute_exact(corpus))
    unique = [(r.doc_id, r.text) for r in exact.collect()]
    near = by["near_dedup"](spark, exact, "").collect()
    classes = brute_classes(unique)
    assert sorted((r.doc_id for r in near), key=str) == sorted((i for i, _, c in classes if i == c), key=str)
    mixed = by["mixing"](spark, exact, "")
    assert mixed.columns == docs.columns
    assert by["bpe"](spark, mixed, "").count() == mixed.count()


def test_pipeline_run(spark, tmp_path, corpus):
    """The whole run over written tables against brute force: nulls, empty texts, repeats, a clashing column, an empty table."""
    import corpus_pipeline
    import tiktoken

    rng = random.Random(14)
    rows = [(*r, 7) for r in corpus if r[0] is None or r[0] != 88] + [(1000 + i, junk(rng), "en", "s9", 0, 7) for i in range(60)]
    schema = SCHEMA + ", mix_shard int"
    d = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] is not None and r[0] % 4], "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        got[r.doc_id, r.n_tokens, r.ids_sha256] += 1
    d = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    good = [tuple(r) for r in quality.keep_good(d, labels).collect()]
    assert 0 < len(good) < len(rows)
    groups = brute_exact(good)
    first = {(min((x for x in g if x is not None), default=None), t) for t, g in groups.items()}
    unique, seen = [], set()
    for r in good:
        key = (r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""))
        if key in first and key not in seen:
            seen.add(key)
            unique.append(r)
    classes = brute_classes([(r[0], r[1]) for r in unique])
    stay = {(i, n) for i, n, c in classes if i == c}
    left = [r for r in unique if (r[0], len(shingle_set(r[1]))) in stay]
    assert len(left) == sum(i == c for i, _, c in classes)
    own = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks={bpe.codec(bpe.default_path(), None, bpe.LEAF).bytes_of[i]: i for i in range(50256)}, special_tokens={})
    want = defaultdict(int)
    for r in mixing.mix(spark.createDataFrame(left, schema)).collect():
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()] += 1
    assert got == want
    (tmp_path / "none").mkdir()
    d.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
