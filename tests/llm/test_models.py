"""Toxicity, language identification, HTML extraction and licences."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import html_extract, language_id, license_scan, toxicity
from corpusmill.llm.license_templates import TEMPLATES

CLEAN = [f"w{k}" for k in range(400)]
M = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_hash(data):
    base = 0x9E3779B97F4A7C15
    return plain_mix(sum(plain_mix((b + 1) * base & M) * pow(base, i, M + 1) for i, b in enumerate(data)) + 1 & M)


def plain_features(text):
    """Toxicity's features written anew: {feature: distinct words that have it, CLIP at most}."""
    out = {}
    for w in set(re.findall(r"[a-z0-9_]+", (text or "").lower())):
        b = w.encode()
        for f in [plain_hash(b), *(plain_mix(plain_hash(b[:n]) + n & M) for n in toxicity.STEMS if len(b) > n)]:
            out[f] = out.get(f, 0) + 1
    return {f: min(n, toxicity.CLIP) for f, n in out.items()}


def corpus(n=400, seed=0, share=0.2):
    r = random.Random(seed)
    rows, bad = [], []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(r.randrange(20, 80))]
        bad.append(r.random() < share)
        if bad[-1]:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["idiotgrumps", "idiotblat", "scumfoo"]))
        rows.append((i, " ".join(words)))
    return rows, bad


def test_toxicity_on_held_out_documents(docs, spark):
    rows, bad = corpus()
    labels = spark.createDataFrame([(i, 1, int(bad[i])) for i in range(200) if bad[i] or i % 3 == 0], "doc_id bigint, quality int, toxic int")
    extra = [(900, None), (901, ""), (None, "w1 idiotblat idiotgrumps"), (902, "w1 " * 300_000)]
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs(rows + extra), labels, prior=0.2).collect()}
    wrong = [i for i in range(200, 400) if got[i]["toxic"] != bad[i]]
    assert len(wrong) <= 6
    assert got[None]["toxic"] and not any(got[i]["toxic"] for i in (900, 901, 902))
    clean = toxicity.keep_clean(docs(rows + extra), labels, prior=0.2)
    assert clean.columns == docs(rows).columns and clean.count() == sum(not x["toxic"] for x in got.values())


def test_toxicity_scores_are_the_sum_over_distinct_words(docs, spark):
    import pyarrow as pa

    from corpusmill.llm.wordhash import WordReader

    names = {}
    for rows, feats, times in toxicity.text_features(pa.array(["idiots idiots run", "run"]), WordReader()):
        for f, n in zip(feats[rows == 0], times[rows == 0]):
            names[int(f)] = int(n)
    assert sorted(names.values()) == [1, 1, 1, 1]  # idiots, its two stems, run


def test_toxicity_without_positives_or_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [x["toxic"] for x in toxicity.toxicity(docs([(1, "a"), (1, "a")]), none).collect()] == [False, False]
    assert toxicity.toxicity(docs([]), none).count() == 0


def test_language_id(docs):
    r = random.Random(1)
    sounds = {"en": ["the", "with", "th", "ing"], "de": ["der", "sch", "ung", "ich"], "fr": ["les", "eau", "ou", "que"], "es": ["los", "cion", "que", "ado"]}
    text = lambda k: " ".join(r.choice(sounds[k]) + r.choice(sounds[k]) for _ in range(60))
    rows = [(i, text(k), k) for i, k in enumerate(list(sounds) * 40)]
    test = [(1000 + i, text(k), None) for i, k in enumerate(list(sounds) * 10)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "!!! ---", None), (None, text("fr"), "fr"), (2003, text("de") * 500, None)]
    got = {x["doc_id"]: x for x in language_id.language_id(docs(rows + test + odd)).collect()}
    assert sum(got[1000 + i]["language"] == k for i, k in enumerate(list(sounds) * 10)) >= 38
    assert [got[i]["language"] for i in (2000, 2001, 2002)] == ["und"] * 3
    assert got[None]["language"] == "fr" and got[None]["family"] == "romance" and got[2003]["language"] == "de"
    assert [x["language"] for x in language_id.language_id(docs([(1, "abc def", None)])).collect()] == ["und"]
    assert language_id.language_id(docs([])).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1, 0.5, (50, 3)), rng.normal(-1, 0.5, (50, 3))]
    y = np.r_[np.ones(50), -np.ones(50)]
    assert (np.sign(np.c_[x, np.ones(100)] @ language_id.svm(x, y)) == y).mean() > 0.95


PAGE = "<html><head><title>T &amp; t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>one</a></li></ul></nav><div class='ad'>buy, buy, buy now at this very place</div><article><p>{}<p>{}</article><footer>foot</footer></body></html>"


def test_html_keeps_prose_and_drops_the_rest():
    a, b = "First, a long sentence with commas, and more words, so that it counts.", "Second &lt;part&gt; of the text, which is long enough, too."
    title, text, score = html_extract.extract(PAGE.format(a, b))
    assert title == "T & t" and text == a + "\nSecond <part> of the text, which is long enough, too." and score > 0


@pytest.mark.parametrize("page", ["", "<", "<p", "<p title='a>b'>x", "</div></div>", "<!-- open", "<script>never closed", "<div>" * 5000 + "deep", "&#x110000; & &amp", "plain"])
def test_html_odd_pages(page):
    title, text, score = html_extract.extract(page)
    assert text is not None and score is not None


def test_html_table(spark):
    p = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 2), (3, None, PAGE.format("x, y, z and then some more words", "y" * 100_000), 3), (3, None, PAGE.format("x, y, z and then some more words", "y" * 100_000), 3)], "page_id bigint, url string, html string, text int")
    got = html_extract.html_extract(p).collect()
    assert [x["text"] is None for x in sorted(got, key=lambda x: x["page_id"])] == [True, False, False, False]
    assert html_extract.html_extract(p.limit(0)).count() == 0


def test_html_keeps_wrapping_forms_and_leads_in_headers():
    prose = "".join(f"<p>Paragraph {i} tells, at some length, what happened on the day, and why.</p>" for i in range(4))
    title, text, score = html_extract.extract(f"<html><body><form id=aspnetForm><div>{prose}</div></form></body></html>")
    assert score > 0 and text.count("Paragraph") == 4
    article = f"<article><header><h1>Head</h1><p>The lead, which sums up all of it.</p></header>{prose}<form><label>E-mail</label><p>Subscribe to our letter today</p></form></article>"
    text = html_extract.extract(f"<body><header><nav><a href=/>Home</a></nav><a href=/>Some site with a long name</a></header>{article}</body>")[1]
    assert "The lead" in text and text.count("Paragraph") == 4 and "Subscribe" not in text and "Some site" not in text
    assert html_extract.extract("<body><form>Short text</form></body>")[1:] == ("Short text", 0.0)


def test_license_scan_finds_exact_and_edited_spans(docs):
    r = random.Random(4)
    noise = lambda n: " ".join(r.choice(CLEAN) for _ in range(n))
    mit = TEMPLATES["MIT/full"]
    edited = mit.replace("free of charge, to", "free of charge and without fee, to").replace("sublicense, ", "")
    rows = [(1, noise(50) + " " + mit + " " + noise(9)), (2, edited), (3, "Released under the MIT License."), (4, noise(300)), (5, None), (6, ""), (7, "the software"), (8, noise(30_000) + "\nLicensed under the Apache License, Version 2.0."), (None, "Released under the MIT License."), (3, "Released under the MIT License.")]
    got = license_scan.license_scan(docs(rows)).collect()
    assert sorted(((x["doc_id"], x["template"]) for x in got), key=str) == sorted([(1, "MIT/full"), (2, "MIT/full"), (3, "MIT/notice"), (8, "Apache-2.0/notice"), (None, "MIT/notice")], key=str)
    one = next(x for x in got if x["doc_id"] == 1)
    assert (one["start"], one["n_words"], one["similarity"]) == (50, len(license_scan.words(mit)), 1.0)
    assert 0.9 < next(x for x in got if x["doc_id"] == 2)["similarity"] < 1
    assert license_scan.license_scan(docs([])).count() == 0


def test_license_scan_finds_whole_texts_parts_and_short_notices(docs):
    bsd, unlicense = (TEMPLATES[k] for k in ("BSD-2-Clause/full", "Unlicense/full"))
    apache = TEMPLATES["Apache-2.0/full"]
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under CC BY-NC-ND 3.0"), (3, bsd), (4, bsd[bsd.index("THIS SOFTWARE IS PROVIDED BY") :]), (5, unlicense), (6, apache), (7, "SPDX-License-Identifier: MIT"), (8, TEMPLATES["GPL-2.0-or-later/grant"])]
    got = {r["doc_id"]: [] for r in docs(rows).collect()}
    for r in license_scan.license_scan(docs(rows)).collect():
        got[r["doc_id"]].append((r["license"], r["start"], r["n_words"], r["similarity"]))
    n = [len(license_scan.words(t)) for _, t in rows]
    ids = ["CC-BY-NC-4.0", "CC-BY-NC-ND-3.0", "BSD-2-Clause", "BSD-2-Clause", "Unlicense", "Apache-2.0", "MIT", "GPL-2.0-or-later"]
    assert got == {k + 1: [(x, 0, n[k], 1.0)] for k, x in enumerate(ids)}
    assert "disclaimed" in license_scan.words(bsd) and len(license_scan.words(apache)) > 1500


def test_license_alignment_equals_dynamic_programming():
    r = random.Random(5)
    for _ in range(60):
        w, t = [[r.choice("abcd") for _ in range(r.randrange(n, 12))] for n in (0, 3)]
        best = len(t)
        for i in range(len(w) + 1):
            row = list(range(len(t) + 1))
            for x in w[i:]:
                new = [row[0] + 1]
                for k, y in enumerate(t, 1):
                    new.append(min(row[k - 1] + (x != y), row[k] + 1, new[-1] + 1))
                row = new
                best = min(best, row[-1])
        assert round(1 - best / len(t), 9) == round(license_scan.similarity(w, t)[0], 9)


def test_toxicity_scores_equal_a_plain_sum(docs, spark):
    rows, bad = corpus(120, seed=3)
    labels = spark.createDataFrame([(i, 1, int(bad[i])) for i in range(120) if bad[i] or i % 3 == 0] + [(None, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    odd = [(900, None), (901, ""), (902, "idiotblat " * 400_000 + "scumfoo"), (None, "idiotgrumps idiotblat"), (5, rows[5][1]), (5, "another text of five")]
    d = docs(rows + odd).selectExpr("*", "'x' AS score", "1 AS toxic", "2 AS positive")
    names, weights, bias = toxicity.model(d, labels)
    w = dict(zip(map(int, names), weights))
    assert len(w) > 3
    got = sorted(((x["doc_id"], x["score"], x["toxic"]) for x in toxicity.toxicity(d, labels).collect()), key=str)
    want = [(i, bias + sum(w.get(f, 0) * n for f, n in plain_features(t).items())) for i, t in rows + odd]
    by = sorted(((i, x, bool(x > 0)) for i, x in want), key=str)
    assert [(i, t) for i, _, t in got] == [(i, t) for i, _, t in by] and np.allclose([x for _, x, _ in got], [x for _, x, _ in by], atol=1e-6)


def test_language_id_equals_a_plain_version(docs):
    r = random.Random(5)
    sounds = {"en": "the with ing", "de": "der sch ung", "nl": "het een ijk", "fr": "les eau que", "es": "los cion ado", "fi": "nen ssa ää"}
    text = lambda k: " ".join(r.choice(sounds[k].split()) + r.choice(sounds[k].split()) for _ in range(r.randrange(3, 30)))
    rows = [(i, text(k), k) for i, k in enumerate(list(sounds) * 12)] + [(500, text("de"), None), (501, "ab", None), (502, None, "en"), (503, "ÄÖ ü", None), (None, text("nl"), "nl"), (0, text("en"), "en"), (504, text("fr") * 30_000, None)]
    d = docs(rows).selectExpr("*", "'f' AS family", "'l' AS language", "0 AS margin", "'v' AS v")
    fitted = language_id.model(d, language_id.FAMILIES, 400, 1)
    weights = {(k, a, b): w for k, a, b, w in fitted["weights"]}

    def plain(t):
        data = [b if b >= 128 or 97 <= b <= 122 else 32 for b in (t or "").lower().encode()]
        grams = [data[i] | data[i + 1] << 8 | data[i + 2] << 16 for i in range(len(data) - 2)]
        at = [(g * 2654435761 & 0xFFFFFFFF) >> 19 for g in grams if g != 0x202020]
        if not at:
            return "und", "und", 0.0
        score = lambda *k: weights[k][-1] + language_id.SCALE * sum(weights[k][x] for x in at) / len(at)
        by_family = sorted(((-score("family", f, ""), f) for f in fitted["families"]))
        family, margins = by_family[0][1], [by_family[1][0] - by_family[0][0]]
        langs = fitted["of"][family]
        of = lambda a, b: score("pair", a, b) if a < b else -score("pair", b, a)
        rank = lambda a: (sum(of(a, b) >= 0 if a < b else of(a, b) > 0 for b in langs if b != a), sum(of(a, b) for b in langs if b != a))
        best = max(langs, key=rank)
        return family, best, min(margins + [abs(of(best, b)) for b in langs if b != best])

    got = sorted(map(tuple, language_id.language_id(d).collect()), key=lambda x: (str(x[0]), x[3]))
    want = sorted(((i, *plain(t)) for i, t, _ in rows if i != 504), key=lambda x: (str(x[0]), x[3]))
    assert [g[:3] for g in got if g[0] != 504] == [w[:3] for w in want] and np.allclose([g[3] for g in got if g[0] != 504], [w[3] for w in want], atol=1e-5)
    assert next(g for g in got if g[0] == 504)[2] == "fr"


def test_language_pieces_of_long_texts_are_one_text():
    texts = pa.array(["abc def " * 50, "", None, "x", "éa " * 40])
    table = language_id.folded()
    for chunk in (1 << 20, 64, 7):
        n = np.zeros((5, language_id.BUCKETS + 1))
        for lo, off, h in language_id.grams(texts, table, chunk):
            for k, (i, j) in enumerate(zip(off[:-1], off[1:]), lo):
                n[k] += np.bincount(h[i:j], minlength=language_id.BUCKETS + 1)
        whole = n if chunk == 1 << 20 else whole
        assert (n[:, :-1] == whole[:, :-1]).all() and n[:, :-1].sum() > 400


class Tree:
    """A page as a tree, and its scores by their definition, over whole subtrees again and again."""

    def __init__(self, tag, kids, cls=""):
        self.tag, self.kids, self.cls, self.up = tag, kids, cls, None
        for k in kids:
            if not isinstance(k, str):
                k.up = self

    def html(self):
        return f"<{self.tag}" + (f' class="{self.cls}"' if self.cls else "") + ">" + "".join(k if isinstance(k, str) else k.html() for k in self.kids) + f"</{self.tag}>"

    def all(self):
        return [self] + [x for k in self.kids if not isinstance(k, str) for x in k.all()]

    def strings(self):
        return [s for k in self.kids for s in ([k] if isinstance(k, str) else k.strings())]

    def length(self):
        return sum(len(s.strip()) for s in self.strings())

    def density(self):
        links = sum(x.length() for x in self.all() if x.tag == "a")
        return links / self.length() if self.length() else 0.0

    def weight(self):
        return -25 * (self.cls == "sidebar") + 25 * (self.cls == "content")


def plain_extract(root):
    h, everything = html_extract, root.all()
    hidden = lambda x: x is not None and (x.tag in h.OUT or hidden(x.up))
    own = lambda x: sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    paragraphs = [x for x in everything if not hidden(x) and x.length() >= h.LEAST and (x.tag in h.PARAGRAPH or x.tag in h.BLOCK and own(x) >= h.LEAST)]
    points, order = {}, []
    for p in paragraphs:
        gain, up = 1 + sum(s.count(",") for s in p.strings()) + min(p.length() / 100, 3), p.up
        for level in range(h.LEVELS):
            if up is None:
                break
            if up not in points:
                points[up] = h.START.get(up.tag, 0) + up.weight()
                order.append(up)
            points[up] += gain / (1 if level == 0 else 2 if level == 1 else level * 3)
            up = up.up
    points = {x: v * (1 - x.density()) for x, v in points.items()}
    if not order:
        return None
    top = max(order, key=lambda x: points[x])
    kept = []
    for x in [k for k in top.up.kids if not isinstance(k, str)] if top.up else [top]:
        prose = x.tag == "p" and (x.length() > 80 and x.density() < 0.25 or 0 < x.length() <= 80 and not any(y.tag == "a" for y in x.all()) and x.weight() >= 0)
        if x is top or prose or x in points and points[x] >= max(10, 0.2 * points[top]) and x.tag not in h.OUT:
            kept.append(x)
    lines = [""]

    def write(x, first):
        if isinstance(x, str):
            lines[-1] += x
            return
        doubtful = x.tag in h.DOUBTFUL and (x.density() >= 0.5 or max([points[y] for y in ([x] if x in points else x.all()) if y in points], default=0) <= 0)
        if x.tag in h.OUT or not first and (x.weight() < 0 or doubtful):
            return
        lines.extend([""] * (x.tag in h.BLOCK))
        for k in x.kids:
            write(k, k in kept if not isinstance(k, str) else False)
        lines.extend([""] * (x.tag in h.BLOCK))

    for x in kept:
        write(x, True)
    return "\n".join(y for y in (" ".join(x.split()) for x in lines) if y), round(points[top], 6)


def test_html_scores_equal_their_definition():
    r = random.Random(11)

    def grow(depth):
        tag = r.choice(["div", "section", "article", "div", "nav", "form", "header", "p", "blockquote"] if depth else ["p", "p", "p", "div"])
        if tag == "p" or depth == 0:
            words = lambda n: " ".join(r.choice(["alpha,", "beta", "gamma", "delta,"]) for _ in range(n))
            kids = [words(r.randrange(1, 30))] + ([Tree("a", [words(r.randrange(1, 9))]), " " + words(2)] if r.random() < 0.4 else [])
            return Tree(tag, kids, r.choice(["", "", "sidebar"]))
        return Tree(tag, [grow(depth - 1) for _ in range(r.randrange(1, 4))], r.choice(["", "", "", "content", "sidebar"]))

    compared = 0
    for _ in range(300):
        root = Tree("body", [grow(r.randrange(1, 5)) for _ in range(r.randrange(1, 4))])
        want = plain_extract(root)
        if want and want[0]:
            assert html_extract.extract(root.html())[1:] == want
            compared += 1
    assert compared > 200


def test_html_time_is_linear_in_deep_and_wide_pages():
    import time

    for page in (lambda n: "<p><button>" + "<div>" * n, lambda n: "<li>" * n, lambda n: "<div><li><p>" * n, lambda n: "<p>some text, of a length that counts, here</p>" * n, lambda n: "<form>" * n + "x, y, z and some more words here" + "</form>" * n):
        began = time.perf_counter()
        html_extract.extract(page(30_000))
        assert time.perf_counter() - began < 20


def plain_license_scan(text, templates, least_votes=0.3, least=0.8):
    """The scan by its definition: all windows against all windows, all spans against all spans."""
    k, words, found = license_scan.K, license_scan.words(text or ""), []
    for name, t in templates.items():
        votes = {}
        for p in range(len(words) - k + 1):
            for q in range(len(t) - k + 1):
                if words[p : p + k] == t[q : q + k]:
                    votes.setdefault(p - q, set()).add(q)
        shift, runs = license_scan.shift_of(len(t)), []
        for d in sorted(votes):
            if runs and d - runs[-1][1] <= shift:
                runs[-1][1:] = [d, runs[-1][2] + len(votes[d])]
            else:
                runs.append([d, d, len(votes[d])])
        for low, high, n in runs:
            if n >= max(1, -(-least_votes * (len(t) - k + 1) // 1)):
                lo = max(0, low - shift)
                s, a, b = license_scan.similarity(words[lo : high + len(t) + shift], t)
                if s >= least:
                    found.append((name, lo + a, b - a, n, round(s, 6)))
    kept = []
    for x in sorted(found, key=lambda x: (-x[4], -x[2], x[0], x[1])):
        if not any(x[1] < y[1] + y[2] and y[1] < x[1] + x[2] for y in kept):
            kept.append(x)
    return kept


def test_license_scan_equals_its_definition(docs):
    r = random.Random(9)
    templates = {"A/full": "permission is granted to use copy and change this work free of any charge whatsoever", "B/short": "under the b license", "C/full": "this work is given as it is without warranty of any kind to you or others", "A/part": "free of any charge whatsoever"}
    vocabulary = " ".join(templates.values()).split()

    def text():
        out = []
        for _ in range(r.randrange(1, 6)):
            out += [r.choice(vocabulary) for _ in range(r.randrange(12))]
            t = r.choice(list(templates.values())).split()
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(["", "x", "y z"])
            out += t
        return " ".join(out)

    rows = [(i, text()) for i in range(60)] + [(100, None), (101, ""), (None, text()), (None, text()), (3, text()), (102, "under the b license " * 3000)]
    d = docs(rows).selectExpr("*", "'l' AS license", "'t' AS template", "1 AS pos", "2 AS votes")
    of = {k: license_scan.words(v) for k, v in templates.items()}
    want = sorted(((i, *x) for i, t in set(rows) - {rows[-1]} for x in plain_license_scan(t, of)), key=str)
    got = [(x["doc_id"], x["template"], x["start"], x["n_words"], x["votes"], x["similarity"]) for x in license_scan.license_scan(d, templates=templates).collect()]
    assert sorted((g for g in got if g[0] != 102), key=str) == want and len(want) > 60
    assert sum(g[0] == 102 for g in got) == 3000


def test_best_spans_are_those_of_all_against_all():
    r = random.Random(2)
    for _ in range(200):
        found = [(r.choice("abc"), r.randrange(60), r.randrange(1, 12), 1, r.choice([0.8, 0.9, 1.0])) for _ in range(r.randrange(30))]
        kept = []
        for x in sorted(found, key=lambda x: (-x[4], -x[2], x[0], x[1])):
            if all(x[1] >= k[1] + k[2] or k[1] >= x[1] + x[2] for k in kept):
                kept.append(x)
        assert license_scan.best_spans(found) == sorted(kept, key=lambda x: (x[1], x[0]))


def test_html_ties_go_to_the_first_and_repeats_repeat(spark):
    one = "<div><p>Some words of prose, of a length that counts, stand here.</p></div>"
    page = one + one.replace("Some", "More")
    top, score, scored = html_extract.best(html_extract.parse(page)[0])
    assert top is scored[0] and [x.points for x in scored] == [score, score]
    p = spark.createDataFrame([(None, None, page, "t", 1.0), (None, None, page, "t", 1.0)], "page_id bigint, url string, html string, title string, score double")
    got = html_extract.html_extract(p).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["text"].startswith("Some") and "More" not in got[0]["text"]


def test_language_ties_and_repeated_rows(docs):
    fitted = {"families": ["f"], "of": {"f": ["a", "b", "c"]}, "weights": [("pair", "a", "b", 0), ("pair", "a", "c", 0), ("pair", "b", "c", 0)]}
    family, language, margin = language_id.decide(np.array([[0.0, 0.0, 0.0], [1.0, -1.0, 1.0]]), fitted)
    assert list(language) == ["a", "a"] and list(family) == ["f", "f"] and list(margin) == [0.0, 1.0]
    got = language_id.language_id(docs([(1, "the end", "en"), (1, "the end", "en"), (2, "das ende", "de")])).collect()
    assert len(got) == 3 and [tuple(x) for x in got if x["doc_id"] == 1][0] == [tuple(x) for x in got if x["doc_id"] == 1][1]


def test_toxicity_gradients_are_the_same_in_one_or_two_steps_and_by_differences(docs):
    from corpusmill.llm.common import written

    from pyspark.sql import functions as F

    texts = docs([(i, t) for i, t in enumerate(["a b c", "b c", "zzz", "a a long", "", "c long"] * 5)]).select(F.lower("text").alias("text")).repartition(4)
    names = np.sort(np.array([plain_hash(w.encode()) for w in ("a", "b", "long")], np.uint64))
    cells = written(texts.mapInArrow(toxicity._cells(names), toxicity.CELLS), "cells")
    w, b = np.array([0.3, -0.2, 0.5]), -0.4
    one, two = (toxicity.gradient_of(cells, 4, w, b, most=m) for m in (256, 1))
    assert np.allclose(one, two)
    loss = lambda w, b: toxicity.gradient_of(cells, 4, w, b)[0]
    step = 1e-5
    assert one[1] == pytest.approx((loss(w, b + step) - loss(w, b - step)) / (2 * step), abs=1e-4)
    for k in range(3):
        e = np.eye(3)[k] * step
        assert one[2 + k] == pytest.approx((loss(w + e, b) - loss(w - e, b)) / (2 * step), abs=1e-4)
