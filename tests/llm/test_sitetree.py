"""Site style trees on labelled pages: hosts with templates of their own."""

import math
import random
import time

import pytest

from tracefield.llm import sitetree

SCHEMA = "page_id long, url string, html string, host int, path string, paths int"
PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><header>Site</header>
<article><h1>Head &amp; line</h1><h2>Summary</h2><p>First  para<br>graph %d.<p>Second <b>bold</b> one %d.<script>var x = "</p>";</script></article>
<aside>Ad</aside><div class="comments"><p>Nice!</p></div><footer>&copy; us</footer></body></html>"""


def extract(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], SCHEMA)
    found = sitetree.extract(pages, **options).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    return found


def body(page, **options):
    return [t for _, t, _ in sitetree.parse(page, **options)[0]]


def one(spark, page):
    """A page that is alone on its host."""
    return extract(spark, [(1, "http://one/", page)])[0]["text"]


def test_pages_of_a_host(spark):
    rows = [(k, f"http://h/{k}", PAGE % (k, k)) for k in range(20)]
    rows += [(90, None, None), (91, "", ""), (92, "http://x/", "plain < text &lt;"), (93, "http://x/", "<p>" + "long " * 200_000), (None, "http://h/0", PAGE % (0, 0)), (3, "http://h/3", PAGE % (3, 3))]
    got = {}
    for r in extract(spark, rows):
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[3] == ["Head & line\nSummary\nFirst para graph 3.\nSecond bold one 3."] * 2
    assert got[None] == got[0]
    assert got[90] == got[91] == [""] and got[92] == ["plain < text <"]
    assert got[93] == [("long " * 200_000).strip()]


def test_main_part_beats_teasers_and_comments(spark):
    story = "<p>%s</p>" % " ".join(["story"] * 60)
    text = " ".join(["story"] * 60)
    assert one(spark, f"<main>{story}</main><article>teaser</article>") == text
    assert one(spark, f'<article>{story}</article><article class="comment">reader says hi</article>') == text
    assert one(spark, f'<article>{story}</article><section class="reader-comments"><article><p>hi</p></article></section>') == text
    assert one(spark, f'<form id="page"><article>{story}</article></form>') == text
    assert one(spark, f'<body>{story}<div class="comment">reader says hi</div></body>') == text
    inside = '<div class="side-effects"><p>none known</p></div><div class="social-history"><p>alone</p></div>'
    assert one(spark, f"<article>{story}{inside}</article>") == text + "\nnone known\nalone"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def labelled(hosts=12, pages=12, seed=5):
    """``(host, html, blocks of main text, other blocks)`` with classes that
    say nothing."""
    out = []
    for h in range(hosts):
        rng = random.Random(seed * 1000 + h)
        fixed = [words(rng, rng.randint(2, 9)) for _ in range(8)]
        for _ in range(pages):
            title, paras = words(rng, 7), [words(rng, rng.randint(20, 70)) for _ in range(rng.randint(3, 9))]
            links = [words(rng, 1 if h % 2 else 3) for _ in range(6)]
            menu = "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(fixed[:5] if h % 3 else links))
            advert, notice, last = words(rng, 9), fixed[5], fixed[6] if h % 4 else words(rng, 6)
            inner = "".join(f"<p>{p}</p>" for p in paras)
            if h % 3 == 0:
                main = f'<div class="k{h}"><h1>{title}</h1><h2>In short</h2>{inner}</div>'
            elif h % 3 == 1:
                main = f'<div class="q"><h1>{title}</h1><div class="z"><h2>In short</h2>{inner}</div></div>'
            else:
                main = f"<section><h1>{title}</h1></section><section><h2>In short</h2>{inner}</section>"
            page = f'<html><body><div class="a"><ul>{menu}</ul></div><div class="b">{advert}</div>{main}<div class="c"><p>{notice}</p></div><div class="d">{last}</div></body></html>'
            if h % 2:
                page = page.replace("<body>", '<body><div class="w">').replace("</body>", "</div></body>")
            out.append((h, page, [title, "In short", *paras], [*(fixed[:5] if h % 3 else links), advert, notice, last]))
    return out


@pytest.mark.parametrize("prior", [0.0, 0.9])
def test_labelled_hosts(spark, prior):
    made = labelled()
    rows = [(k, f"https://host{h}.org/{k}", page) for k, (h, page, _, _) in enumerate(made)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract(spark, rows, prior=prior)}
    kept = sum(b in got[k] for k, (*_, main, _) in enumerate(made) for b in main)
    wrong = sum(b in got[k] for k, (*_, other) in enumerate(made) for b in other)
    mains = sum(len(m[2]) for m in made)
    print(f"prior {prior}: precision {kept / (kept + wrong):.4f}, recall {kept / mains:.4f}")
    assert kept >= 0.99 * mains and kept >= 0.99 * (kept + wrong)


@pytest.mark.parametrize("piece", ['<a "', "<div>", "<b>x</i>", "<a x\">'", "<", "<ul><li>", "<table><td>", "<!--", "<a b='", "<p>a"])
def test_malformed_markup_takes_linear_time(piece):
    def seconds(n):
        page, began = piece * (n // len(piece)), time.process_time()
        sitetree.page_row(page)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(400_000) < 20 * seconds(50_000) + 0.5


def test_blocks_of_a_page():
    assert body("a<br>b<p>c &amp; <i>d</i>e<div>f</div>g") == ["a b", "c & de", "f", "g"]
    assert body('<p hidden>x<p>y<div style="display: none"><b>z</b></div>') == ["y"]
    assert body("1 < 2 <3 > x <b>y") == ["1 < 2 <3 > x y"]
    assert body("<script>a</script>b<title>c") == ["b"]


def host(inner, before="", n=12, seed=3):
    """Pages of one host, ``inner(rng)`` in each article, and their paragraphs."""
    pages, paras = [], []
    for k in range(n):
        rng = random.Random(seed * 100 + k)
        own = [words(rng, rng.randint(25, 60)) for _ in range(4)]
        pages.append((k, f"http://host/{k}", f"<html><body>{before}<article><h1>{words(rng, 5)}</h1><p>{own[0]}</p><p>{own[1]}</p>{inner(rng)}<p>{own[2]}</p><p>{own[3]}</p></article></body></html>"))
        paras.append(own)
    return pages, paras


def lines_of(spark, pages, **options):
    return {r["page_id"]: r["text"].split("\n") for r in extract(spark, pages, **options)}


@pytest.mark.parametrize("prior", [0.0, 0.9])
def test_an_unnamed_box_of_an_article_goes(spark, prior):
    pages, paras = host(lambda rng: '<div class="k1">Buy our great product here today</div>')
    got = lines_of(spark, pages, prior=prior)
    assert all(set(own) <= set(got[k]) and "Buy our great product here today" not in got[k] for k, own in enumerate(paras))


def test_a_named_block_of_an_article_stays(spark):
    said = []

    def answers(rng):
        said.append(words(rng, 30))
        return f'<div class="reply"><p>{said[-1]}</p></div>'

    pages, paras = host(answers)
    got = lines_of(spark, pages)
    assert all({*own, said[k]} <= set(got[k]) for k, own in enumerate(paras))


@pytest.mark.parametrize("size", [8, 400])
def test_a_common_notice_goes_however_long(spark, size):
    notice = words(random.Random(1), size)
    pages, paras = host(lambda rng: "", f'<div class="n1">{notice}</div>')
    got = lines_of(spark, pages)
    assert all(set(own) <= set(got[k]) and notice not in got[k] for k, own in enumerate(paras))


def test_formulas_and_deep_nesting(spark):
    text = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold in all that follows here</p></article>"
    assert one(spark, text) == "Let x=2 hold in all that follows here"
    deep = "<div>" * 60
    pages, paras = host(lambda rng: f'{deep}<div class="ad1">same offer on each page</div><p>{words(rng, 40)}</p>{"</div>" * 60}')
    got = lines_of(spark, pages)
    assert all(set(own) <= set(got[k]) and "same offer on each page" not in got[k] and len(got[k]) == 6 for k, own in enumerate(paras))


def test_trees_against_a_plain_merge(spark):
    made = [(k, f"https://host{h}.org/{k}", page) for k, (h, page, _, _) in enumerate(labelled(4, 6))]
    made += [(100, "https://host0.org/again", made[0][2])]
    df = spark.createDataFrame([(i, u, p, 1, "x", 2) for i, u, p in made], SCHEMA)
    got = {(r["host"], r["path"]): r for r in sitetree.worth(df, 0.1, 0.9).collect()}
    seen, pages, blocks, up, chars = {}, {}, {}, {}, {}
    for (name, _), row in {(u.split("/")[2], sitetree.page_row(p)[0]): sitetree.page_row(p) for _, u, p in made}.items():
        _, total, nodes, texts = row
        pages[name] = pages.get(name, 0) + 1
        for path, parents, _, children, _, _ in nodes:
            seen.setdefault((name, path), []).append(children)
            up[name, path] = parents
            chars[name, path] = chars.get((name, path), 0) + total
        for path, content, n, links in texts:
            blocks.setdefault((name, path), {}).setdefault(content, []).append((n, links))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    own = {}
    for (name, path), found in blocks.items():
        part = {c: max(0.0, 1 - math.log(len(x)) / math.log(pages[name])) for c, x in found.items()}
        own[name, path] = (sum(n for x in found.values() for n, _ in x), sum(k for x in found.values() for _, k in x), sum(part[c] * n for c, x in found.items() for n, _ in x))

    def entropy(children):
        n = len(children)
        shares = [children.count(c) / n for c in set(children)]
        return -sum(s * math.log(s) for s in shares) / math.log(n) if n > 1 else 0.0

    assert {(h, signed(p)) for h, p in seen} == set(got)
    for (name, path), children in seen.items():
        below = [(h, p) for h, p in seen if h == name and (p == path or path in up[h, p])]
        sums = [sum(own.get(b, (0, 0, 0.0))[k] for b in below) for k in range(3)]
        r = got[name, signed(path)]
        assert r["presentation"] == pytest.approx(max(entropy(seen[b]) for b in below), abs=1e-9)
        assert r["content"] == pytest.approx(sums[2] / sums[0] if sums[0] else 0.0, abs=1e-9)
        assert r["share"] == pytest.approx(sums[0] / max(1, chars[name, path]), abs=1e-9)
