import math
import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from drafthaus.llm import embedding_dedup, html_extract, licenses, line_dedup, mixing, ngram_join, queries, sentencepiece_bpe, topk_search, toxicity, url_filter

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "x " * 30000), (7, "x " * 30000 + "y"), (8, "日本語 é ß \x00 😀")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", None) for i, t in ODD], DOC)


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_ngram_join_families(spark):
    rnd = random.Random(4)
    docs = []
    for _ in range(4):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([30, 60, 120]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randrange(2)] = [f"w{rnd.randrange(300)}"]
            docs.append(" ".join(w))
    rows = list(enumerate(docs + ["", "a", "a b", "A  B", None]))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def joined_as_brute_force(spark, docs):
    rows = list(enumerate(docs))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(sets, links)
    return links


def test_ngram_join_nested(spark):
    rnd = random.Random(5)
    docs = []
    for n in range(1, 57):
        for extra in {n // 4, n // 4 + 1}:  # at 0.8 or just over it, and just under it
            for end in range(4):
                w = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4 + extra)]
                docs += [" ".join(w), " ".join(w[extra * (end % 2) :][: n + 4])]
    assert len(joined_as_brute_force(spark, docs)) > 150


def test_ngram_join_hub_with_own(spark):
    rnd = random.Random(6)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(10):
        common, z = new(104), new(52)
        # the hub has 8 shingles that no other text has and 8 of two others; the pair is linked, neither to the hub
        docs += [" ".join(w) for w in (common + new(11), common + new(11), z[:12] + new(4) + common[:101], z, z + new(3))]
    for _ in range(20):
        tree = [new(rnd.choice([60, 100, 160]))]
        for _ in range(12):
            w = list(rnd.choice(tree))
            for _ in range(rnd.choice([1, 2, 3])):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randrange(2)] = new(1)
            tree.append(w)
        docs += [" ".join(w) for w in tree[1:]]  # edit trees without their root
    joined_as_brute_force(spark, docs)


def test_ngram_join_odd(spark):
    got = ngram_join.ngram_jaccard_join(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (None, 5), (6, 6), (7, 7 if len(shingles(ODD[8][1]) & shingles(ODD[7][1])) * 100 < 80 * len(shingles(ODD[8][1]) | shingles(ODD[7][1])) else 6), (8, 8)}
    assert ngram_join.ngram_jaccard_join(odd_docs(spark).limit(0)).count() == 0
    clash = odd_docs(spark)
    for c in ("_i", "_key", "i", "key", "d", "n"):
        clash = clash.withColumn(c, F.lit(c))
    once = ngram_join.one_of_each(clash)
    assert once.columns == clash.columns and once.where("_i = '_i' and key = 'key'").count() == once.count()
    kept = [r.doc_id for r in once.collect()]
    assert sorted(x for x in kept if x in (1, 2, 3, 4, 5, 8)) == [1, 2, 3, 4, 5, 8] and None not in kept
    assert ngram_join.one_of_each(clash.limit(0)).count() == 0


def test_ngram_join_short_pairs(spark):
    """Texts of 1 to 40 words and their prolongations, all links against brute force; and one far beyond a chunk."""
    rnd = random.Random(11)
    docs = []
    for n in (8, 12, 16, 20, 40):
        for _ in range(40):
            w = [f"w{rnd.randrange(10**9)}" for _ in range(n + (n - 4) // 4)]
            docs += [" ".join(w[:n]), " ".join(w)]
    docs += [" ".join(f"w{rnd.randrange(4)}" for _ in range(rnd.randrange(1, 41))) for _ in range(700)]
    long = " ".join(f"w{i}" for i in range(80_000))
    assert len(long) > 400_000
    assert len(joined_as_brute_force(spark, [*docs, long, long + " more words at the end", long.upper()])) > 202


def test_licenses(spark):
    texts = {1: "Released under the MIT License.", 2: "CC BY-NC and again cc by nc", 3: None, 4: "", 5: "this work is licensed under the gnu general public licence version 3", 6: "Apache License, Version 2.0", 7: "x " * 50000 + "under the mit license"}
    docs = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_spans(docs).collect()}
    base = lambda i: [(s.label, s.first) for s in got[i].spans if s.exact]
    assert base(1) == [("mit", 1)] and base(2) == [("cc-by-nc", 0), ("cc-by-nc", 5)] and base(6) == [("apache-2", 0)] and base(7) == [("mit", 50000)]
    assert got[3].n_words == 0 and got[4].spans == [] and got[7].n_words == 50004
    assert "gpl-3" not in {s.label for s in got[5].spans if s.exact}
    assert licenses.license_spans(docs).count() == 8 and licenses.license_spans(docs.limit(0)).count() == 0
    # the base places against brute force
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    rows = queries.op2_license_scans(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        w = licenses._words(texts[r.doc_id] or "")
        hits = sorted((i, x) for p, x in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1


def test_licenses_brute_force(spark):
    """All columns of the query, votes on diagonals counted the plain way."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_license_scans(spark, SF).collect():
        w = licenses._words(texts[r.doc_id] or "")
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        labels, score = set(), 0.0
        for _, label, text, exact in licenses.TEMPLATES:
            t = licenses._words(text)
            votes = {}
            for j in range(len(t) - 2):
                for i in at.get(tuple(t[j : j + 3]), []):
                    votes.setdefault(i - j, set()).add(j)
            islands, last = [], None
            for d in sorted(votes):
                if last is None or exact or d - last > 2:
                    islands.append(set())
                islands[-1] |= votes[d]
                last = d
            for x in islands:
                share = len(x) / (len(t) - 2)
                if share >= (1.0 if exact else 0.7):
                    labels.add(label)
                    score = max(score, share)
        assert r.labels == ",".join(sorted(labels)) and abs(r.score - score) < 1e-12
    assert licenses.template_positions(spark, [], 3).count() == 0


def test_sentencepiece_query(spark):
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_sentencepiece(spark):
    import sentencepiece

    path = queries.tokenizer_path()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceBPE(open(path, "rb").read())
    rnd = random.Random(1)
    texts = ["", " ", "  a", "▁", "a▁b", "<s>", "<0x0A>", "\n \n", "=" * 99] + ["".join(rnd.choice("aeinst rl  \n\té日😀▁=-_01") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for t in texts:
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.both(t)[2] == lib.decode(ids), repr(t)
    for _ in range(2000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.6 else rnd.randrange(259) for _ in range(rnd.randrange(8))]
        assert own.decode(ids) == lib.decode(ids)
    got = sentencepiece_bpe.sentencepiece_round_trip(odd_docs(spark), path, outputs=("ids", "decoded", "n_tokens"), keep=("doc_id", "lang"))
    assert got.count() == len(ODD)
    for r in sentencepiece_bpe.decode_ids(got.withColumnRenamed("decoded", "d"), path).collect():
        assert r.decoded == r.d and r.n_tokens == len(r.ids) == len(lib.encode(r.d))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, usable=~queries.held_out())
    s = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(queries.held_out()).toPandas()
    assert (s[s.toxic == 1].score >= 0.5).mean() > 0.7 and (s[s.toxic == 0].score >= 0.5).mean() < 0.02
    got = toxicity.score_toxicity(odd_docs(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    clash = odd_docs(spark).withColumn("score", F.lit("s")).withColumn("c0", F.lit("c"))
    assert toxicity.clean_documents(clash, model).columns == clash.columns and toxicity.clean_documents(clash, model).where("score = 's' and c0 = 'c'").count() > 5
    assert toxicity.clean_documents(clash.limit(0), model).count() == 0 and toxicity.score_toxicity(clash.limit(0), model).count() == 0
    data = np.frombuffer(("idiot pathetic und Ärger " * 30_000).encode(), np.uint8)
    whole, short = (sorted(toxicity.word_features(d, np.array([0, len(d)]))[1][:, 0].tolist()) for d in (data, data[:26]))
    assert whole == short  # a long text in pieces has the same distinct words
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score_toxicity(odd_docs(spark), empty).count() == len(ODD)


def test_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = [(1, None), (2, "nothing"), (3, "http://a.example.NET/en/x?y"), (4, "http://example.net/fr"), (5, "http://net"), (6, "https://www.example.com/de/1#x"), (7, "http://notexample.com/de/"), (7, "http://notexample.com/de/"), (8, "http://x.org/fr/://net/")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), rules).collect() if r.rule or r.page_id < 3 or r.page_id == 5 or r.page_id == 7 or r.page_id == 8)
    assert [(g[0], g[3], g[4]) for g in got if g[3]] == [(3, "example.net/en/", "allow"), (4, "net/", "block"), (6, "example.com/de/", "block"), (8, "org/fr/", "allow")]
    assert len(got) == len(urls) and (5, "net", "", None, "allow") in got
    many = [("", "/a", "block"), ("a.b.c.d.e", "", "allow"), ("c.d.e", "/x", "block"), ("C.D.E", "/x", "allow"), (None, "/", "block"), ("e", None, "block")]
    odd = [(1, "http:///ab"), (2, "http://a.b.c.d.e/x"), (3, "http://c.d.E/xyz"), (4, "http://" + "q." * 20000 + "e/" + "p" * 50000), (5, "http://e?x")]
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame([(*o, "x") for o in odd], "page_id long, url string, short string"), spark.createDataFrame(many, "host string, path string, verdict string")).collect()}
    assert found == {1: ("/a", "block"), 2: ("a.b.c.d.e", "allow"), 3: ("c.d.e/x", "block"), 4: ("e", "block"), 5: ("e", "block")}
    assert url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_embeddings(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = t.collect()
    rng = np.random.default_rng(5)
    x = np.array([r.embedding for r in rows], float)
    # pairs right above and below the limit
    u = x[:200] / np.linalg.norm(x[:200], axis=1)[:, None]
    z = rng.standard_normal(u.shape)
    z -= (z * u).sum(1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = np.where(np.arange(200) % 2, 0.9501, 0.9499)[:, None]
    extra = c * u + np.sqrt(1 - c**2) * z
    every = np.concatenate([x, extra])
    ids = [r.vec_id for r in rows] + [10**6 + i for i in range(200)]
    n = every / np.linalg.norm(every, axis=1)[:, None]
    near = n @ n.T >= 0.95
    np.fill_diagonal(near, False)
    want = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, every)] + [(-1, None), (-2, [0.0] * 64), (-3, [math.nan] * 64), (-4, [])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (-1, -2, -3, -4))
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(k), want[i]) for i, k in zip(ids, near.sum(1))}
    assert embedding_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def deduped(rows, unit, min_words):
    """Brute force: (id, text) after removal, by the definition, unit by unit."""
    split = {"line": lambda t: re.finditer(r"[^\n]+", t), "sentence": lambda t: re.finditer(r"[^\n]*?[.!?]+(?=[ \t\r\f\v])|[^\n]+", t)}[unit]
    seen, out = set(), []
    for i, t in sorted(rows):
        found = [(m.span(), " ".join(m.group().lower().split())) for m in split(t or "")]
        found = [x for x in found if x[1]]
        again, mine = [], set()
        for _, s in found:
            again.append(s in seen or s in mine)
            mine.add(s)
        seen |= mine
        keep, k = t, len(found) - 1
        while k >= 0:
            if again[k]:
                j = k
                while j > 0 and again[j - 1]:
                    j -= 1
                if sum(len(s.split()) for _, s in found[j : k + 1]) >= min_words:
                    keep = keep[: found[j][0][0]] + keep[found[k][0][1] :]
                k = j
            k -= 1
        out.append((i, keep))
    return out


@pytest.mark.parametrize("unit, min_words", [("line", 1), ("sentence", 30)])
def test_substrings_brute_force(spark, unit, min_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = deduped([(r.doc_id, r.text) for r in docs.collect()], unit, min_words)
    got = line_dedup.dedup_substrings(docs, unit, min_words).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:  # the original offsets lead to the same text
        t = text[r.doc_id]
        for s in reversed(r.removed):
            t = t[: s.start] + t[s.end :]
        assert t == r.text


def test_substrings(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, f"Intro one.\n{passage}\nEnd one."), (2, f"Other start.\n{passage.upper()}\nOther end."), (3, f"Inline here. {passage} Then more."), (4, "Intro one.\nOnly this."), (5, None), (6, ""), (2, f"Other start.\n{passage.upper()}\nOther end."), (None, "Only this."), (7, "x. " * 40000)], "doc_id long, text string")
    for c in ("removed", "doc", "key", "spans", "_doc", "_key", "_spans", "digest"):
        docs = docs.withColumn(c, F.lit(c))
    got = line_dedup.dedup_substrings(docs, "sentence", 30).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == 9 and text[1].count("word59") == 1 and "WORD59" not in text[2] and "word59" not in text[3] and len(text[7]) < 10
    assert text[4] == "Intro one.\nOnly this." and text[5] is None and text[6] == "" and text[3].startswith("Inline here.") and text[3].endswith("Then more.")
    r = next(r for r in got if r.doc_id == 2)
    s = r.removed[0]
    assert f"Other start.\n{passage.upper()}\nOther end."[s.start : s.end] == passage.upper() and r.doc == "doc" and r._spans == "_spans"
    every = {r.doc_id: r.text for r in line_dedup.dedup_substrings(docs).collect()}
    assert every[4] == "\nOnly this." and every[None] == "" and every[2] == "Other start.\n\nOther end." and passage in every[3]
    assert line_dedup.dedup_substrings(docs.limit(0)).count() == 0
    began = time.time()
    assert len(line_dedup.units("." * 1_000_000, "sentence")) == 1 and len(line_dedup.units(". " * 300_000, "sentence")) == 300_000 and len(line_dedup.units("\n" * 1_000_000, "paragraph")) == 0
    assert len(line_dedup.units("a\nb\n \n\nc", "paragraph")) == 2 and time.time() - began < 3


def test_html(spark):
    html = '<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav><article><h1>The  title</h1><p>First &amp; <b>bold</b> paragraph, which is long enough. It goes on.</p><p>Second one here, with more text in it. And more.</p></article><div class="comments"><div class="comment"><p>Nice post, thanks.</p></div></div><footer>&copy; site</footer></body></html>'
    df = spark.createDataFrame([(1, html, "u"), (2, None, None), (3, "", None), (1, html, "u"), (4, "just text", None)], "page_id long, html string, url string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert got[1] == "The title First & bold paragraph, which is long enough. It goes on. Second one here, with more text in it. And more."
    assert got[2] == got[3] == "" and got[4] == "just text" and html_extract.extract_main_text(df).count() == 5
    one = "One sentence stands here, and no more than that."
    known = {
        f"<article><p>A &amp; <b>B. </b>{one}</p></article>": f"A & B. {one}", f"Lead text here. <p>{one}</p>": f"Lead text here. {one}", f"<article>{one}</article>": one, f"<p>{one}": one,
        f"<article><h1>T</h1><p>{one} <math><mi>x</mi></math> is.</p></article>": f"T {one} x is.", "&lt;b&gt; &am<b>p;": "<b> &amp;", "<p> </p>": "",
    }
    assert html_extract.main_texts(list(known)) == list(known.values())
    # all pages of the table, whose article is marked
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    marked = [re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br|ul|li)>", " ", p.html[p.html.index("<article>") + 9 : p.html.index("</article>")])) for p in pages]
    texts = html_extract.main_texts([p.html for p in pages])
    assert np.mean([" ".join(unescape(m).split()) == t for m, t in zip(marked, texts)]) > 0.99
    began = time.time()
    for deep in ("<div>" * 100_000 + "text", "<b>" * 100_000 + "x", ("<div>" * 1000 + "</i>" * 1000) * 20, "<ul>" * 20_000 + "<li>a</li>" * 20_000, "<div>" * 20_000 + "<dd>a</dd>" * 20_000, "<p>" * 100_000):
        html_extract.main_texts([deep])
    assert time.time() - began < 30
    rng = np.random.default_rng(77)
    made = [html_extract._generated(rng) for _ in range(100)]
    right = 0
    for m in made:
        page = html_extract.Page(m)
        main = [False] * len(page.tag)
        for k, t in page.pieces:
            main[k] |= "\x02" in t
        right += page.text(main).replace("\x02", "") == html_extract.main_texts([m.replace("\x02", "")])[0]
    assert right >= 75
    clash = df.select("*", F.lit(1).alias("text"), F.lit(2).alias("c0"))
    assert html_extract.extract_main_text(clash).where("c0 = 2 and text = 'just text'").count() == 1 and html_extract.extract_main_text(df.limit(0)).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a = mixing.mix_sources(docs).toPandas()
    b = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert dict(zip(a.doc_id, a.copies)) == dict(zip(b.doc_id, b.copies))
    a["taken"] = a.copies * a["size"]
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 0.01 * per.target).all() and (a.copies <= 2).all() and (per.target <= 2 * per["size"] + 1e-6).all()
    assert abs(per.target.sum() - 1.5 * a["size"].sum()) < 1
    odd = mixing.mix_sources(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) and {r.source for r in odd} == {None, "s"}
    assert mixing.mix_sources(odd_docs(spark).limit(0)).count() == 0
    clash = odd_docs(spark)
    for c in ("copies", "rows", "nth", "_copy", "_mix_key", "key", "_t", "id"):
        clash = clash.withColumn(c, F.lit(c))
    mix = mixing.mixed_documents(clash)
    assert mix.columns == clash.columns and mix.where("copies = 'copies' and _mix_key = '_mix_key' and id = 'id'").count() == sum(r.copies for r in odd)


def test_mixing_targets_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size, n = {}, {}
    for r in docs:
        n[r.doc_id] = len(WORD.findall(r.text or ""))
        size[r.source] = size.get(r.source, 0) + n[r.doc_id]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        level = (1.5 * sum(size.values()) - 2 * sum(size[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    want = {s: 2.0 * size[s] if s in full else weight[s] * level for s in order}
    rows = queries.op9_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs}
    assert len(rows) == len(docs)
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == n[r.doc_id] and r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * want[s] + 1e-9 and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in order)  # whole copies of some 50 documents a source, one of them large


def test_top_k(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = t.collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    ids = np.array([r.vec_id for r in rows])
    got = topk_search.top_k(t.where("vec_id % 50 = 0"), t.unionByName(t.limit(3)), 5).collect()
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:5]
        want |= {(int(ids[q]), k + 1, int(j), int(-v)) for k, (v, j) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [1.0, 0.5]), (5, [1.0, 0.5]), (None, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in topk_search.top_k(odd, odd).collect()} == {(4, 5), (5, 4)}
    assert topk_search.top_k(odd.limit(0), odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    comp = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in comp.items() if i == c) and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "ids", "n_tokens"}
