import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from maskloom.llm import html_text as H
from maskloom.llm import katz as K
from maskloom.llm import pieces as SP
from maskloom.llm import pii, quality
from maskloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}

# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("0012.@+-( )a %:9é") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(t) == brute_base(t), t
    assert pii.base_spans("9" * 100_000 + "a" * 100_000 + "@") == []


def test_field_on_held_out_zones():
    """Precision and recall of each kind, exact spans, on made-up zones that were not learnt from."""
    w = dict(pii.trained())
    hits, extra, missed = Counter(), Counter(), Counter()
    for text, gold in pii.training_zones(3000, 99):
        found = set(pii.field_spans(text, w))
        hits.update(s[0] for s in found & set(gold))
        extra.update(s[0] for s in found - set(gold))
        missed.update(s[0] for s in set(gold) - found)
    told = {k: (round(hits[k] / (hits[k] + extra[k]), 3), round(hits[k] / (hits[k] + missed[k]), 3)) for k in pii.KINDS}
    print(told)
    assert all(p > 0.95 and q > 0.95 for p, q in told.values()), told


def test_many_spans_are_swept():
    import time

    text = "a@b.de +1 (555) 123-4567\n(555) 123-4567 at 10.0.0.1 " * 2000
    began = time.perf_counter()
    base, spans = pii.all_spans(text, dict(pii.trained()))
    assert len(base) >= 6000 and len(spans) > len(base) and time.perf_counter() - began < 30
    for (_, _, b), (_, a, _) in zip(sorted(spans, key=lambda s: s[1]), sorted(spans, key=lambda s: s[1])[1:], strict=False):
        assert b <= a


def brute_best(n, cands, w):
    scores = pii._scores(cands, w)
    best = (0.0, ())

    def walk(at, score, taken, touching):
        nonlocal best
        if at == n:
            best = max(best, (score, tuple(taken)), key=lambda x: x[0])
            return
        walk(at + 1, score, taken, False)
        for i, j, c, k, s, _ in scores:
            if i == at:
                walk(j, score + s + (w.get(("touch", -1), 0.0) if touching else 0.0), [*taken, (c, k)], True)

    walk(0, 0.0, [], False)
    return best


def test_decoding_equals_brute_force():
    w = dict(pii.trained())
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice(["12", "@", ".", " ", "+1", "(555)", "a", "4111111111111111", "-", "10.0.0.1"]) for _ in range(r.randint(1, 7)))
        for a, b in pii.zones(text):
            n, cands = pii.candidates(text, a, b)
            if n > 12:
                continue
            got = pii.decode(n, cands, w)
            total = lambda taken: brute_total(taken, cands, w)
            assert math.isclose(total(got), brute_best(n, cands, w)[0], abs_tol=1e-9)


def brute_total(taken, cands, w):
    scores = {(c, k): s for _, _, c, k, s, _ in pii._scores(cands, w)}
    total, end = 0.0, -1
    for c, k in taken:
        total += scores[c, k] + (w.get(("touch", -1), 0.0) if cands[c][0] == end else 0.0)
        end = cands[c][1]
    return total


def test_pii_rows_and_masks(spark, odd, nothing):
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    rows = pii.pii_report(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            base = brute_base(texts[r.doc_id])
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    masked = pii.mask_pii(odd)
    assert masked.columns == odd.columns and masked.filter("doc_id = 9").first().text == "Released under the MIT License.\nmail [EMAIL] [PHONE]"
    assert pii.pii_report(nothing).count() == 0 and pii.mask_pii(nothing).count() == 0


def test_clean_texts_are_left_alone():
    w = dict(pii.trained())
    for t in ["Version 1.2.3 of 2024-01-05 costs $1,200.50.", 'token = "9a9b9c9999aa99b9c9d9e9f90123456789abcdef"', "call me @home5 at 12:30:45", "plain words only", "12/34 12/34 12/34 12/34 12", "paid 12/24 12/25 12/26 12/27", "size 120x240x1000, 12, 144, 1200, 99"]:
        assert pii.all_spans(t, w)[1] == []


# ---- pages


def slow_article(page):
    a = page.index("<article>") + 9
    b = page.find("</article>", a)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", page[a : b if b >= 0 else len(page)])))
    return "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)


def test_pages_give_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries()["op6_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == slow_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_page_parts():
    para = "<p>One, two, three and a good many more words of a real paragraph, as articles have.</p>"
    page = f"""<body><header><p>Site, name, here</p></header><div class=cookie-notice>Accept, all, cookies</div><div id="content"><div class="post"><h2>T &amp; U</h2>{para}<ul><li>x<li>y</ul><form><p>a, b, c</p></form>
<aside>more, of, it</aside><table><tr><td>1<td>2</table><script>var a = "<p>no</p>";</script><p>end</div><div class="comments"><p>First, comment, ever</p></div></div><footer>c</footer>"""
    assert H.main_text(page) == "T & U\nOne, two, three and a good many more words of a real paragraph, as articles have.\nx\ny\n1\n2\nend"
    for bad in ["", "<", "<p", "</p></p>", "<!--", "<a href='>", "<script>", "text only", "<div>" * 5000 + "deep" + "</div>" * 5000, "&lt;p&gt;"]:
        H.main_text(bad)
    assert H.main_text("text only, here") == "text only, here" and H.main_text("<nav>a</nav>") == ""


def test_pages_without_article_elements(spark):
    """The same pages with the article in a plain container: found by its points alone."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        wanted = slow_article(r.html)
        body = r.html.replace("<article>", "<div class=post>").replace("</article>", "</div>")
        if len(wanted) > 400:
            assert H.main_text(body) == wanted, r.page_id
            assert H.main_text(body.replace("<body>", "<body><div><div>").replace("<footer>", "</div></div><footer>")) == wanted, r.page_id


def test_lists_of_links_go():
    para = "<p>One, two, three and a good many more words of a real paragraph, as articles have.</p>"
    text = para[3:-4]
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a>" for i in range(8)) + "</ul>"
    for page in (f"<main><article>{para}{para}{links}</article>{links}</main>", f"<main><div>{para}{para}</div>{links}</main>", f"<body><div>{para}{links}{para}</div></body>"):
        assert H.main_text(page) == f"{text}\n{text}", page
    inline = "<p>See <a href=a>one</a>, <a href=b>two</a> and <a href=c>three</a>, which are, as ever, only words in a sentence.</p><ul><li>plain<li>items, too</ul>"
    assert H.main_text(f"<article>{inline}</article>") == "See one, two and three, which are, as ever, only words in a sentence.\nplain\nitems, too"
    assert H.main_text(f"<article>{para}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>") == f"{text}\nLet x=2 hold."


def test_long_pages_take_linear_time():
    import time

    for page in ("<div>" + "<p>a, b, c</p>" * 50_000 + "</div>", "<div>" * 20_000 + "<p>deep, text, here</p>", "<b>" * 20_000 + "</i>" * 20_000 + "x", "<p>a" * 30_000, "<ul>" + "<li>a, b" * 30_000, ("<div><p>a, b</p>" * 20_000)):
        began = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - began < 8
    assert H.main_text("<div>" * 5000 + "<p>deep, text</p><p>two, more</p>" + "</div>" * 5000) == "deep, text\ntwo, more"
    assert H.main_text("<div>" + "<p>a, b, c</p>" * 50_000 + "</div>").count("\n") == 49_999


def test_pages_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in H.extract(rows).collect()) == [("1", ""), ("1", "x"), ("None", "")]
    assert H.extract(rows.limit(0)).count() == 0


# ---- backoff


def slow_katz(docs, vocabulary, model_words):
    """Base scores and scores of (id, text), by dictionaries."""
    tokens = [(i, (t or "").translate(LOW).encode().split() + [b""]) for i, t in docs]
    train = [t for i, t in tokens if not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)]
    c = Counter(w for t in train for w in t)
    n, whole = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    of = {w: k for k, w in enumerate(model_words, 2)} | {b"": 1}
    pairs, context, mass = Counter(), Counter(), Counter({0: 0.5})
    for t in train:
        p = 1
        for w in t:
            pairs[p, of.get(w, 0)] += 1
            context[p] += 1
            p = of.get(w, 0)
    for w, k in c.items():
        mass[of.get(w, 0)] += k + 0.5
    d = K.good_turing(np.array([sum(v == r for v in pairs.values()) for r in range(1, 7)], float))
    seen = {}
    for (a, b), k in pairs.items():
        seen.setdefault(a, {})[b] = k

    def p(b, a):
        if a not in seen:
            return mass[b] / whole
        own = seen[a]
        kept = sum((d[k - 1] if k <= K.K else 1) * k for k in own.values())
        plain = context[a] - kept <= 1e-9 * context[a]
        left = 1 / (context[a] + 1) if plain else (context[a] - kept) / context[a]
        rest = 1 - sum(mass[x] for x in own) / whole
        if b in own:
            k = own[b]
            share = k / (context[a] + 1) if plain else (d[k - 1] if k <= K.K else 1) * k / context[a]
            return share / (1 - left) if rest <= 1e-12 else share
        return left / rest * mass[b] / whole

    out = []
    for i, t in tokens:
        base = sum(math.log10((c[w] + 0.5) / whole) for w in t)
        score, before = 0.0, 1
        for w in t:
            score += math.log10(p(of.get(w, 0), before)) + (math.log10((c[w] + 0.5) / mass[0]) if of.get(w, 0) == 0 else 0.0)
            before = of.get(w, 0)
        out.append((str(i), len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(score, 4)))
    return sorted(out), p, of


@pytest.mark.parametrize("vocabulary,part", [(100_000, 1_500_000), (200, 3000), (3, 2000)])
def test_scores_equal_brute_force(spark, vocabulary, part):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    from pyspark.sql import functions as F

    words, _ = K.frequent(K.word_counts(docs.select(K.text_of("text").alias("_t"), K.held_out().alias("held_out"), F.col("doc_id").alias("_id"))), vocabulary)
    assert len(words) <= vocabulary
    expected, p, of = slow_katz(rows, vocabulary, words)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in K.katz_scores(docs, vocabulary=vocabulary, tokens_in_part=part).collect())
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-6, abs_tol=1e-3) and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-3)
    for context in [1, 0, 2]:
        assert math.isclose(sum(p(b, context) for b in range(len(words) + 2)), 1, rel_tol=1e-9)


def test_model_beats_its_base(spark):
    r = K.katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(x.score for x in r) > sum(x.base_score for x in r)


def test_scores_odd_rows(odd, nothing, spark):
    rows = K.katz_scores(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.score <= 1e-9 and math.isfinite(r.base_score) for r in rows)
    assert K.katz_scores(nothing).count() == 0
    untrained = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in K.katz_scores(untrained).collect()} == {(0, 0, 0.0, 0.0)}


# ---- quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in queries()["op8_quality_classifier"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scored[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.values())
    right = sum(scored[r.doc_id].predicted == r.quality for r in labels) / len(labels)
    assert right > 0.93, right


def test_gradients():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(k, quality.N_FEATURES)) for k in (1, 4, 7)]
    x, first, y, weight = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    m = quality.Model(seed=3)
    loss = lambda: float(-(weight * (y * np.log(m.forward(x, first)["score"]) + (1 - y) * np.log(1 - m.forward(x, first)["score"]))).mean())
    for k, g in m.gradient(x, first, y, weight).items():
        at = tuple(0 for _ in m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-7), k


def slow_score(m, text):
    """The forward pass of one document, number by number."""
    rows = []
    for p in quality.passages(text):
        shares = [0.0] * quality.BUCKETS
        for w in p:
            shares[zlib.crc32(bytes(c + 32 if 65 <= c <= 90 else c for c in w)) % quality.BUCKETS] += 1 / len(p)
        x = [*quality.describe(p), *map(math.sqrt, shares)]
        rows.append([(v - a) / b for v, a, b in zip(x, m.mean, m.scale, strict=True)])
    dot = lambda v, w: [sum(a * w[i][j] for i, a in enumerate(v)) for j in range(len(w[0]))]
    hidden = [[math.tanh(a + b) for a, b in zip(dot(x, m.p["W"]), m.p["b"], strict=True)] for x in rows]
    weights = []
    for h in hidden:
        t, g = map(math.tanh, dot(h, m.p["V"])), (1 / (1 + math.exp(-v)) for v in dot(h, m.p["U"]))
        weights.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, m.p["a"], strict=True))))
    z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, m.p["c"], strict=True)) - m.p["d"][0]))


def test_scores_equal_a_slow_forward_pass(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 3000}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i in sorted(texts)[:60]:
        assert math.isclose(got[i], slow_score(model, texts[i]), rel_tol=1e-4, abs_tol=1e-5)


def test_an_id_that_comes_often_is_one_example(spark):
    often = spark.createDataFrame([(4, "first text here"), *[(4, "second text, here.")] * 500, (8, "ANOTHER text")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, quality int")
    once = often.distinct()
    a, b = (quality.train(d, labels) for d in (often, once))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (8, 0, 0), (8, None, 1), (None, 1, 0), (11, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.good(odd, model).columns == odd.columns
    untaught = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, untaught).collect()} == {1.0} and quality.good(odd, untaught).count() == odd.count()
    assert quality.score(nothing, model).count() == 0


# ---- pieces


def brute_score(s, table, below):
    best = {0: 0.0}
    for end in range(1, len(s) + 1):
        options = [best[start] + table[s[start:end]] for start in range(end) if s[start:end] in table]
        if s[end - 1] not in table:
            options.append(best[end - 1] + below)
        best[end] = max(options)
    return best[len(s)]


def test_segmentation_is_the_best(spark):
    m = SP.PieceModel.load(SP.model_path())
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(SP.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    table = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
    shown = [p.piece for p in proto.pieces]
    texts = [r.text[:300] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["  a   b ", "日本\n\n語 😀x", "\n", " ", "▁x▁"]
    for t in texts:
        ids = m.encode(t)
        s = "▁" + t.replace(" ", "▁")
        score, at = 0.0, 0
        while at < len(ids):
            if shown[ids[at]].startswith("<0x"):
                raw = bytes([int(shown[ids[at]][3:5], 16)])
                while True:
                    try:
                        raw.decode()
                        break
                    except UnicodeDecodeError:
                        at += 1
                        raw += bytes([int(shown[ids[at]][3:5], 16)])
                score += m.below
            else:
                score += table[shown[ids[at]]]
            at += 1
        assert score == brute_score(s, table, m.below), t
        assert m.decode(ids) == t.replace("▁", " ")
    whole = SP.PieceModel.load(SP.model_path())
    whole.words = None  # no cutting into words
    assert [whole.encode(t) for t in texts] == [m.encode(t) for t in texts]


def test_library_agrees_on_words(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(SP.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # its lattice search over the same pieces and scores
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), SP.PieceModel.load(SP.model_path())
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() for w in r.text.split() if w.isascii() and w.isalpha()}
    table = {p.piece: p.score for p in proto.pieces}
    score = lambda pieces: sum(table[x] for x in pieces)
    for w in sorted(words)[:1500]:
        assert score(lib.nbest_encode_as_pieces(w, 5)[0]) == score([proto.pieces[i].piece for i in m.encode(w)])


def test_small_models():
    m = SP.PieceModel([("<unk>", 0, 2), ("a", -1, 1), ("ab", -3, 1), ("b", -2, 1), ("a b", -1, 1)], dummy_prefix=False)
    assert m.encode("abab") == [2, 2] and m.encode("axb") == [1, 0, 3] and m.decode([1, 0, 3]) == "a ⁇ b" and m.encode("") == []


def test_models_that_map_characters():
    """Compatibility forms are mapped first, and the library's lattice search over the same model gives the same score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.ClearField("pieces")
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("▁ABC", -3, 1), ("A", -4, 1), ("B", -4.5, 1), ("C", -4, 1), ("fi", -2.5, 1), ("f", -3, 1), ("i", -3, 1), ("▁fi", -3, 1), ("x", -3, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.pad_id = 0, 1, 2, -1
    m, lib = SP.PieceModel.of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in ["ＡＢＣ　ﬁ  x", "ﬁﬁ ABC", "  x ", "", "ＡC"]:
        assert m.encode(t) == lib.encode(t), t
    assert m.decode(m.encode("ＡＢＣ　ﬁ  x")) == "ABC fi x"


def test_pieces_odd_rows(odd, nothing):
    rows = SP.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = SP.decode(SP.encode(odd).filter("doc_id = 9")).first()
    assert back.text == odd.filter("doc_id = 9").first().text
    assert SP.encode(nothing).count() == 0 and SP.decode(SP.encode(nothing)).count() == 0


@pytest.mark.parametrize("common", [None, 300, 0])
def test_no_word_loses_its_own_bigrams(spark, monkeypatch, common):
    """Every trained word is a context and has bigrams of its own, whichever words are sent to all tasks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = {w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in (t or "").translate(LOW).encode().split()}
    expected, _, _ = slow_katz(rows, None, sorted(train))
    if common is not None:
        monkeypatch.setattr(K, "COMMON", common)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in K.katz_scores(docs, tokens_in_part=2000).collect())
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-6, abs_tol=1e-3) and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-3)


def test_rare_words_of_a_large_vocabulary_keep_their_bigrams(spark):
    spread = " ".join(f"w{i} w{i + 1}" for i in range(0, 300_000, 2))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    free = [i for i in range(100) if i not in ids]
    docs = spark.createDataFrame([(free[0], spread), (ids[0], "w4 w5"), (ids[1], "w4 w7")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in K.katz_scores(docs).collect()}
    assert score[ids[0]] > score[ids[1]] + 1


def test_long_zones_are_read_as_a_whole():
    """Numbers that go on without a newline: each value is found, wherever in the zone it stands."""
    w = dict(pii.trained())
    for pad in range(0, 16, 5):
        text = "1" * pad + " " + "(555) 123-4567 " * 600
        phones = [s for s in pii.field_spans(text, w) if s[0] == "phone" and "4567" in text[s[1] : s[2]]]
        ends = [s[2] for s in phones]
        assert all(any(abs(e - m.end()) <= 1 for e in ends) for m in re.finditer("4567", text)), pad


def test_marked_wrappers_keep_the_article():
    para = "<p>One, two, three and a good many more words of a real paragraph, as articles have.</p>"
    text = para[3:-4]
    for name in ["layout has-sidebar", "no-sidebar", "content related-work", "page social", "search-result", "block hidden md:block", "hasSidebar"]:
        assert H.main_text(f"<body><nav>menu</nav><div class='{name}'><article>{para}</article></div></body>") == text, name
        assert H.main_text(f'<body><div class="{name}">{para}{para}</div><div class="sidebar"><p>other</p></div></body>') == f"{text}\n{text}", name
    assert H.main_text(f"<body><form id='aspnetForm'><div class='menu'>a</div><div>{para}</div></form></body>") == text
    assert H.main_text(f"<body><article>{para}</article><section class='related'><article>more</article></section></body>") == text
    assert H.main_text(f"<body><div>{para}</div><div class='comments'><article>{para}{para}</article></div></body>") == text
    assert H.main_text(f"<body><div>{para}</div><div hidden><p>x</p></div></body>") == text
