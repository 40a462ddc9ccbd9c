import collections
import hashlib
import html.parser
import math
import random
import re
import zlib

import pytest

from axisloom.llm import html_main, lang_id, secrets

SAMPLES = {
    "en": "the of and to in that is was for with this have from they which their would there",
    "de": "der die und das nicht von sich auf für ist dem eine werden auch nach über durch wir",
    "fr": "le la les des une est que pour dans qui sur avec pas plus sont mais nous vous être",
    "es": "el los las una que por con para como está pero más este todo ser también muy hasta",
}


def documents(n=240):
    rng = random.Random(6)
    rows = []
    for d in range(n):
        lang = sorted(SAMPLES)[d % 4]
        rows.append((d, " ".join(rng.choices(SAMPLES[lang].split(), k=rng.randint(8, 60))).capitalize() + ".", lang))
    return rows


def test_languages(spark):
    rows = documents() + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (None, "the of and to in that is was", "en"), (1003, "le la les des une est que", None), (1003, "le la les des une est que", None), (1004, "und das nicht von sich auf " * 60000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string")
    model = lang_id.train(docs)
    assert model.families == ["germanic", "romance"] and model.languages["romance"] == ["es", "fr"]
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    want = {d: lang for d, _, lang in rows if lang}
    held = [d for d in want if d is not None and d < 1000 and zlib.crc32(str(d).encode()) % 5 == 0]
    assert held and all(got[d]["held_out"] for d in held) and sum(r["held_out"] for d, r in got.items() if d is not None and d < 1000) == len(held)
    assert sum(got[d]["lang_pred"] == want[d] for d in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[d]["lang_pred"] for d in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] == "fr" and got[1004]["lang_pred"] == "de" and got[None]["lang_pred"] == "en"
    kept = lang_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() >= len(rows) - 3 - 2
    nothing = lang_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(docs, nothing).collect()} == {"und"} and lang_id.identify(docs.limit(0), model).count() == 0


def plain_features(text):
    """The counts of hashed 1- to 3-grams of letters, character by character; other characters count as one gap."""
    code = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    counts = collections.Counter()
    for n in range(3):
        for at in range(len(code) - n):
            value = code[at]
            for c in code[at + 1 : at + n + 1]:
                value = (value * 0x01000193 + c) % 2**32
            if code[at] or n and code[at + n]:
                counts[((value ^ n) * 0x9E3779B1) % 2**32 >> 21] += 1
    length = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / length for k, v in counts.items()}


def test_predictions_match_a_plain_machine(spark):
    """Family by the largest margin, then votes of all pairs in it, from dot products over the n-grams of a text alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs)
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    seen = collections.Counter()
    for r in docs.filter("length(text) < 4000").collect():
        x = plain_features(r["text"])
        margin = lambda w: sum(v * w[k] for k, v in x.items()) + w[-1]  # noqa: E731, B023
        chance = lambda m: 1 / (1 + math.exp(-3 * m))
        family, best = max(((f, margin(w)) for f, w in zip(model.families, model.family_weights, strict=True)), key=lambda p: p[1])
        wins = collections.Counter()
        least = collections.defaultdict(lambda: 1.0)
        for a, b, w in model.pairs[family]:
            p = chance(margin(w))
            wins[a if p >= 0.5 else b] += 1
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        lang = wins.most_common(1)[0][0]
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - min(chance(best), least[lang])) < 1e-6
        seen[lang] += 1
    assert len(seen) == 4 and sum(seen.values()) > 100


def test_prediction_reads_the_text_only(spark):
    docs = spark.createDataFrame([(d, t, lang) for d, t, lang in documents()], "doc_id bigint, text string, lang string")
    model = lang_id.train(docs)
    a = model.predict([t for _, t, _ in documents()])
    b = model.predict([t for _, t, _ in documents()][::-1])
    assert a[0] == b[0][::-1]


STRANGE = [
    "Wczoraj wieczorem w Warszawie odbyło się spotkanie przedstawicieli rządu z przedsiębiorcami, podczas którego omówiono zmiany w przepisach",
    "Eilen illalla Helsingissä pidettiin kokous, jossa keskusteltiin uusista säännöistä ja niiden vaikutuksista yrityksiin",
    "Вчера вечером в Москве состоялась встреча представителей правительства с предпринимателями",
    "昨天晚上在北京举行了一次重要的会议讨论了新的经济政策和对企业的影响",
    "xq zkw vvpt qqj bzzx wkfj xqzv pkqw jjxz zqkx wvvk qpzx kjwq",
    "#### 12345 x $$$ %% q 99 ~~ zx 00 ||| k",
]


def test_texts_in_no_known_language_are_dropped(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(rows)
    planted = spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(STRANGE)], rows.schema)
    left = {r["doc_id"] for r in lang_id.keep_identified(rows.unionByName(planted), model).collect()}
    assert not [STRANGE[-1 - d] for d in left if d < 0]
    held = [r["doc_id"] for r in rows.filter(lang_id.held_out(rows["doc_id"])).collect()]
    assert len(left.intersection(held)) >= 0.99 * len(held)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site a better place for all of us, do you agree?</div>
<article class="post"><h1>A title &amp; more</h1><!-- note --><p>First&nbsp;paragraph with <b>bold</b>
 words<br>and a <a href="x">link</a> in it.<p>Second one.</p><aside>Read also this</aside><div class="ad">Buy now</div>
<section id="comments"><p>A reader says that this was a very good article, and a long comment too.</p></section>
<form><label>Name</label><input></form></article><footer>&copy; 2024 Site</footer></body></html>"""


def test_html():
    assert html_main.main_text(PAGE) == "A title & more\n\nFirst paragraph with bold words and a link in it.\n\nSecond one."
    assert html_main.main_text(None) == "" and html_main.main_text("") == "" and html_main.main_text("<p") == "" and html_main.main_text("<a href='x") == ""
    plain = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div>" + "word " * 60 + "</div><div>" + "more " * 50 + "</div><div><a href=3>Next</a></div></body>"
    assert html_main.main_text(plain) == ("word " * 60).strip() + "\n\n" + ("more " * 50).strip()
    for broken in ("<div " * 3000, "<p>" * 3000 + "x", "<a '" * 3000, "&amp" * 1000, "<!--" * 2000, "</div>" * 2000):
        html_main.main_text(broken)


def test_html_query(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<article><p>" + "long text " * 100000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_main.extract(pages).collect()
    assert len(got) == 5 and {r["page_id"]: r["n_chars"] for r in got} == {1: len(html_main.main_text(PAGE)), 2: 0, None: 0, 3: 999_999}
    assert html_main.extract(pages.limit(0)).count() == 0


def test_tree_fits_its_table():
    tree = html_main.grow(list(html_main.LABELLED))
    assert sum(html_main.judge(tree, r) == bool(r[-1]) for r in html_main.LABELLED) >= 0.97 * len(html_main.LABELLED)
    assert len(html_main.LABELLED) <= 200 and tree[0] in html_main.SHALLOW


LONG, SHORT = "plain words of a text " * 24, "a few words"


@pytest.mark.parametrize("page, want", [
    ("<body><h1>Title here</h1><p>A short first paragraph of text.</p><p>Another short one follows.</p></body>", ["Title here", "A short first paragraph of text.", "Another short one follows."]),
    (f'<div id="page" class="right-sidebar"><p>{LONG}</p></div>', [LONG]),
    (f'<article class="post no-comments"><p>{LONG}</p><p>{SHORT}</p></article>', [LONG, SHORT]),
    (f'<main class="topic-social-policy"><p>{SHORT}</p></main>', [SHORT]),
    (f'<div class="layout has-sidebar"><article><p title="the hidden garden">{SHORT}</p></article></div>', [SHORT]),
    (f'<form id="whole"><nav><a href="x">{SHORT}</a></nav><main><p>{SHORT}</p></main><div class="site-footer">{SHORT}</div></form>', [SHORT]),
    (f'<article><p>{LONG}</p></article><section id="comments"><article class="comment-body"><p>{LONG * 4}</p></article></section>', [LONG]),
    (f'<article><p>{LONG}</p><aside>{LONG}</aside><p>{SHORT}</p></article><aside><article><p>{SHORT}</p></article></aside>', [LONG, SHORT]),
    (f'<p>{LONG}</p><p hidden>{LONG}</p><p style="display: none">{LONG}</p><p>{LONG}</p>', [LONG, LONG]),
    (f'<ul><li><a href="a">One</a><li><a href="b">Two</a></ul><div>{LONG}</div><p>{SHORT}</p><div>{LONG}</div><div><a href="c">Next</a></div>', [LONG, SHORT, LONG]),
    (f'<div class="cookie-notice">{LONG}</div><p>{LONG}</p><div class="user-comments"><p>{SHORT}</p></div>', [LONG]),
    (f'<div role="main"><p>{LONG}</p></div><div role="search">{LONG}</div>', [LONG]),
])
def test_pages_of_other_shapes(page, want):
    assert html_main.main_text(page) == "\n\n".join(w.strip() for w in want)


class PlainReader(html.parser.HTMLParser):
    """Text of paragraphs and headings of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append("")
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def test_pages_match_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        reader = PlainReader()
        reader.feed(r["html"])
        assert got[r["page_id"]] == "\n\n".join(t for p in reader.parts if (t := " ".join(p.split())))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark):
    rng = random.Random(7)
    bits = ['password: "hunter22"', "ToKeN=abc", "secret = token = abcdefgh", "api_key:'x/y+z_0.='", "apikey=123456", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "AKIAAKIA" + "B" * 16, "0123456789abcdef01234567",
            "deadbeef" * 2, "é日𝄞", "https://db.example.com/x", "username=carol", "aB3" * 12, "plain words", "\n", "deadbeef" * 6, "passwd:" + "f" * 40]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(150)]
    far = "https://a.example" + " x" * 300 + "password=abcdef123"
    near = "https://a.example" + " x" * 20 + "password=abcdef123"
    rows = [*enumerate(texts), (900, None), (901, ""), (None, near), (902, far), (903, near), (903, near), (904, "é𝄞 " * 50000 + "token=abcdef")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_hex int")
    got = secrets.secret_spans(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        spans, r = base(t or ""), by[d]
        shown = ",".join(f"{secrets.KINDS[n]}:{s}:{e}" for s, n, e in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(n == k for _, n, _ in spans) for k in range(3)], t
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in secrets.KINDS[:3]] == [x for x in shown.split(",") if x]
        starts = [int(x.split(":")[1]) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts)
    assert "endpoint" in by[903]["spans"] and "endpoint" in by[None]["spans"] and "endpoint" not in by[902]["spans"]
    assert secrets.secret_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, kinds", [("username=carol " + "aB3" * 12, "account blob"), ("username=carol", ""), ("aB3" * 12, ""), ("https://x.example token: abcdef", "endpoint assign"), ("AKIA" + "A1" * 8 + " " + "aB3" * 12, "access blob")])
def test_weak_parts_need_company(spark, text, kinds):
    (row,) = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [x.split(":")[0] for x in row["spans"].split(",") if x] == kinds.split()
