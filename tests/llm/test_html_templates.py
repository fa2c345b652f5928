"""Equivalence classes and templates of web pages against a brute-force builder, on pages that no tag or name marks."""

import random
import time
from collections import Counter, defaultdict

from shardloom.llm import html_extraction as he

SCHEMA = "page_id long, url string, html string"


def site(rng, i, host="a.example"):
    """A page without article tags and with names that say nothing: menu, notice on some pages, article, reader notes, imprint."""
    word = lambda: f"{rng.choice('bcdfgklmn')}{rng.choice('aeiou')}{rng.randrange(900)}"
    said = lambda n: " ".join(word() for _ in range(n))
    title, parts = said(4), [said(rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))]
    notes = "".join(f'<div class="q7"><b>{said(2)}</b><i>{said(6)}</i><u>Answer</u></div>' for _ in range(rng.randrange(0, 5)))
    notice = '<div class="k9">We keep crumbs</div>' if i % 3 else ""
    html = (
        f'<html><body><div class="z1"><span>Home</span><div>World news</div></div>{notice}<div class="z2"><div class="z3"><h1>{title}</h1><p class="share-price">{parts[0]}</p><div class="z4">Read on</div>'
        + "".join(f"<p>{p}</p>" for p in parts[1:])
        + f'</div><div class="z5"><h3>Notes</h3>{notes}</div></div><div class="z6">Imprint of {host}</div></body></html>'
    )
    return (i, f"http://{host}/{i}", html), "\n".join([title, *parts])


def plain_classes(htmls):
    """The frequent, valid and nested classes of a host's pages, from whole occurrence vectors."""
    pages = [he.Page(h) for h in dict.fromkeys(htmls) if h]
    runs = [[he._signed(t) for t in p.tokens()] for p in pages]
    vectors = defaultdict(lambda: [0] * len(pages))
    for n, run in enumerate(runs):
        for t in run:
            vectors[t][n] += 1
    groups = defaultdict(set)
    for t, v in vectors.items():
        on = sum(map(bool, v))
        if on >= 2 and 2 * on > len(pages):
            groups[tuple(v)].add(t)
    spine = {t for v, own in groups.items() if all(n == 1 for n in v) for t in own}
    out = set()
    for v, own in groups.items():
        orders, slots = set(), set()
        for run in runs:
            mine = [t for t in run if t in own]
            if not mine:
                continue
            k = len(set(mine))
            orders.add(tuple(mine[:k]) if all(t == mine[j % k] for j, t in enumerate(mine)) else None)
            last = 0
            for t in run:
                if t in spine:
                    last = t
                elif t in own:
                    slots.add(last)
        if len(orders) == 1 and None not in orders and len(slots) <= 1:
            out.add(frozenset(own))
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [site(rng, i)[0] for i in range(17)] + [site(rng, 100 + i, "b.example")[0] for i in range(2)] + [site(rng, 200, "c.example")[0]]
    # a page with its parts in another order, so that some classes are not valid; an empty and a null page
    odd = rows[3][2].replace('<span>Home</span><div>World news</div>', '<div>World news</div><span>Home</span>')
    rows += [(300, "http://a.example/odd", odd), (301, "http://a.example/empty", ""), (302, "http://a.example/null", None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    held = he.weighed(df.where("html IS NOT NULL AND html <> ''").selectExpr("xxhash64(lower(regexp_extract(url, '//([^/]*)', 1))) AS host", "html"))
    names = {r.host: r.name for r in df.selectExpr("xxhash64(lower(regexp_extract(url, '//([^/]*)', 1))) AS host", "regexp_extract(url, '//([^/]*)', 1) AS name").distinct().collect()}
    found = defaultdict(lambda: defaultdict(set))
    for r in he.templates(held).collect():
        found[names[r.host]][r["class"]].add(r.token)
    for name in names.values():
        expected = plain_classes([h for _, u, h in rows if f"//{name}/" in u])
        assert {frozenset(x) for x in found[name].values()} == expected
    assert found["a.example"] and found["b.example"] and not found["c.example"]


def test_pages_without_marks(spark):
    rng = random.Random(8)
    made = [site(rng, i) for i in range(40)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame([r for r, _ in made], SCHEMA)).collect()}
    for (i, _, html), expected in made:
        assert got[i] == expected
        assert he.main_text(html, None) != expected  # it is the template that decides


def test_repeated_pages_change_nothing(spark):
    rng = random.Random(9)
    rows = [site(rng, i)[0] for i in range(9)]
    once = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for again in (2, 3, 12):
        several = he.extract(spark.createDataFrame(rows + [rows[0]] * again, SCHEMA)).collect()
        assert {r.page_id: r.text for r in several} == once and Counter(r.page_id for r in several)[0] == again + 1


def test_marked_articles_keep_what_the_author_repeats(spark):
    rows = [(i, f"http://d.example/{i}", f'<body><nav>Menu</nav><article><h1>Daily</h1><p>Good day.</p><div class="x1">Tell friends</div><p>News {i}</p></article></body>') for i in range(5)]
    assert {r.text for r in he.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"Daily\nGood day.\nNews {i}" for i in range(5)}


def test_names_are_read_whole():
    for name in ("ad", "site-header", "post-comments", "cookieNotice", "discussion", "reader-response", "comment list"):
        assert he.says_aside(name)
    for name in ("share-price", "menu-recipe", "header-image-story", "adage", "content", "post", "sidekick", "notice-period"):
        assert not he.says_aside(name)


def test_very_deep_and_long_pages():
    """Cost grows with the page, not with its square."""
    for tag in ("div", "article", "li", "p", "b", 'div class="comments"'):
        began = time.process_time()
        text = he.main_text(f"<{tag}>x" * 16_000, None)
        assert time.process_time() - began < 3, tag
        assert text.count("x") == (0 if "comments" in tag else 16_000)
    began = time.process_time()
    assert he.main_text("<div>" * 16_000 + "x" + "</div>" * 16_000, None) == "x"
    assert he.main_text("<p>a</b>" * 50_000, None).count("a") == 50_000
    assert time.process_time() - began < 5
