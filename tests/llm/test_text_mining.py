"""Spelling variants, HTML extraction and collocations on small and odd inputs, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from lumenclip.llm import collocations, pages, spellings
from lumenclip.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, word string, n long, key string, phrase string, h long, f long, k int, host string"
ODD = [None, "", " \n\t ", ".,;:!?", "İstanbul Σς é 日本語 it's", "x" * 9000, "word " * 3000, "été ÉTÉ naïve naïveté", "a.b.c", "one two"]


def table(spark, texts, lang=lambda i: "en"):
    small_batches(spark)
    return spark.createDataFrame([(i, t, lang(i), None, 0, "w", 1, "k", "p", 2, 3, 4, "h") for i, t in texts], SCHEMA)


# ------------------------------------------------------------------------------------------------------- spellings
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_rows(texts, letters, least, times, modulus):
    n = Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if modulus and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    beside = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in beside.items() if v}
    form = {w: f for w, f in best.items() if n[f] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(beside[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize("seed,modulus", [(0, 7), (1, 199), (2, None)])
def test_spellings_by_brute_force(spark, seed, modulus):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.choice([3, 4, 5, 6, 7, 12, 70, 300]))) for _ in range(60)]
    texts = []
    for i in range(300):
        words = [rng.choice(stems[: rng.choice([5, 20, 60])]) for _ in range(30)]
        for j in range(len(words)):
            if rng.random() < 0.2:
                w, at = words[j], rng.randrange(len(words[j]))
                words[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "d" + w[at:], w[:at] + "d" + w[at + 1 :], w.upper()])
        texts.append((i, rng.choice([" ", "-", "3"]).join(words)))
    texts += [(None, texts[0][1]), texts[1], *((400 + i, t) for i, t in enumerate(ODD))]
    got = spellings.spelling_groups(table(spark, texts), least_letters=3, least=2, times=2, modulus=modulus)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == spelling_rows(texts, 3, 2, 2, modulus)


def test_spellings_that_share_all_but_two_places(spark):
    """One crowded group that fills many blocks, whose words differ in the same two places."""
    words = [f"stand{a}{b}point" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    n = {w: 1 + i % 3 for i, w in enumerate(words)}
    got = {r.word: r for r in spellings.spelling_groups(table(spark, [(1, " ".join(w for w in words for _ in range(n[w])))]), least=1, times=3, modulus=None).collect()}
    assert len(got) == 400 and all(r.n_near == 38 for r in got.values())
    for w, r in got.items():
        best = min((v for v in words if near(v, w)), key=lambda v: (-n[v], v))
        assert r.form == (best if n[best] >= 3 * n[w] else None)


def test_spellings_of_nothing(spark):
    assert spellings.spelling_groups(table(spark, [])).count() == 0
    assert spellings.spelling_groups(table(spark, list(enumerate(ODD[:5])))).count() == 0


# ---------------------------------------------------------------------------------------------------- collocations
def collocation_rows(rows, least, top, longest):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inner = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and count[p[i:j]] <= a}
        scored = []
        for p, a in found.items():
            if p not in inner:
                score, _, left, right = min((1000 * a * total[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed,head,side,keep", [(0, 1 << 16, 1024, 1 << 20), (1, 8, 2, 50), (2, 1, 1, 1)])
def test_collocations_by_brute_force(spark, monkeypatch, seed, head, side, keep):
    """With all units ranked in one dense tile, and with small heads, tiles and tables."""
    for name, value in (("HEAD", head), ("SIDE", side), ("KEEP", keep)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Ärger", "X"]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 8))) for _ in range(12)]
    texts = [rng.choice([" ", ", ", "\n", "\t", ": "]).join(rng.choice(phrases + vocabulary[:4]) for _ in range(rng.randrange(25))) for _ in range(200)]
    texts += [*ODD, texts[0], texts[0]]
    lang = lambda i: [None, "und", "en", "de", "en"][i % 5]
    got = collocations.collocations(table(spark, list(enumerate(texts)), lang).repartition(3), least=6, top=40)
    want = collocation_rows([(lang(i), t) for i, t in enumerate(texts)], 6, 40, 5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, list(enumerate(ODD))), least=10_000).count() == 0


# ----------------------------------------------------------------------------------------------------------- pages
@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    for seed in range(400):
        rng = random.Random(seed)
        a, b = ([rng.randrange(1 + seed % 6) for _ in range(rng.randrange(14))] for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        m = pages.common(a, b)
        assert len(m) == longest[-1][-1] and all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("plain &amp; simple &eacute;&#233;&#x4e2d; &am", "plain & simple éé中 &am"),
        ("<nav>menu</nav><article><header><h1>Title</h1></header><p>One<b>bold</b>\n two<p>Three</article><footer>end</footer>", "Title\nOnebold two\nThree"),
        ("<main><p>a</p><aside>side</aside><form>f</form></main><p>outside</p>", "a"),
        ("<header>site</header><div><p>open</p><div class='cookie-notice'>we use cookies</div><p>more</div>", "open\nmore"),
        ("<article><p>text</p><section id=comments><article class=comment>reader</article></section></article>", "text"),
        ("<article>x<script>var a='<p>no</p>';</script><style>p{}</style>y<!-- <p>no --> z</article>", "xy z"),
        ("<article><p title='a > b'>kept<br>line</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "kept line\none\ntwo\n1 2\n3"),
        ("<article><p>a <span class='ad'>buy</span> b</p></article>", "a\nb"),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden='true'>no</p><p>yes", "yes"),
        ("<article></article><div>open</div>", ""),
        ("<p>1 < 2 and <a href=x>link</a><p>unclosed <a title=\"", "1 < 2 and link\nunclosed <a title=\""),
        ("<script>never closed", ""),
        ("<article><h1>A</h1><p><b>B<br><p>C</p><p>D</article></body>", "A\nB\nC\nD"),
    ],
)
def test_main_text(html, want):
    assert pages.main_text(html, [])[0] == want


def page_rows(spark, rows):
    return spark.createDataFrame([(*r, "k", "g", "x", "p") for r in rows], "page_id long, url string, html string, key string, gone string, text string, part string")


def test_pages_of_a_site_without_landmarks(spark):
    small_batches(spark)
    chrome = lambda i, body: f"<div>Welcome to the site</div><div>Home</div>{body}<div>All rights reserved {i % 2}</div>"
    rows = [(i, f"http://h.example/{'ab'[i % 2]}/{i:03}.html", chrome(i, f"<p>Story {i}</p><p>about {i * i}</p>")) for i in range(60)]
    # A copy under another path, a page of its path's first one, another host, no host, nothing at all, and repeats.
    rows += [(100, "http://h.example/a/000x", rows[0][2]), (101, "http://h.example/a/002/?q=1#top", chrome(0, "<p>Other</p>")), (102, "http://alone.example/", chrome(0, "<p>x</p>")), (103, None, chrome(0, "<p>y</p>")), (104, "no url", None), (None, "http://h.example/z", ""), (5, rows[7][1], rows[7][2]), rows[3], rows[3]]
    got = defaultdict(list)
    for r in pages.html_extraction(page_rows(spark, rows).repartition(5)).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i in range(2, 60):
        assert {r.text for r in got[i] if r.url == rows[i][1]} == {f"Story {i}\nabout {i * i}"}, i
    assert len(got[3]) == 3 and len(got[5]) == 2
    assert got[101][0].text == "Other" and got[101][0].n_shared == 3
    assert got[102][0].text.startswith("Welcome") and got[103][0].text.startswith("Welcome") and (got[104][0].text, got[104][0].n_chars) == ("", 0)
    assert pages.html_extraction(page_rows(spark, [])).count() == 0


def test_articles_keep_the_lines_that_neighbours_quote(spark):
    rows = [(i, f"http://h.example/{i:02}", f"<nav>Menu</nav><article><p>Quoted by all</p><p>Own {i}</p></article>") for i in range(20)]
    got = pages.html_extraction(page_rows(spark, rows)).collect()
    assert {r.text for r in got} == {f"Quoted by all\nOwn {i}" for i in range(20)} and {r.n_shared for r in got} == {1}


def test_nearest_pages_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{rng.choice('aaab')}.example/{rng.randrange(40)}{rng.choice(['', '/', '.html', '?q=1'])}", f"<p>{i}") for i in range(150)]
    keyed = page_rows(spark, rows).drop("key").selectExpr("page_id", "url", "html", "page_id AS key")
    outlined = pages.outlines(keyed).cache()
    lines = {r.key: r.lines for r in outlined.collect()}
    first = {}
    for i, url, _ in rows:
        first.setdefault(re.match(r"http://([^/]+)(/\d+)", url).groups(), i)
    order = sorted(first)
    for r in pages.nearest(outlined.repartition(7))[0].collect():
        at = order.index((r.host, r.path))
        want = [order[at]] + [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == r.host]
        assert [(p.key, p.lines) for p in r.others] == [(first[k], lines[first[k]]) for k in want]
    outlined.unpersist()
