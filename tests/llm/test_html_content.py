import random
import re
from functools import lru_cache

from watchgrid.llm.html_content import Node, _shape, align, extract, from_outline, in_order, main_text, outline, parse


def text_of(page):
    return main_text(parse(page), set())


def test_main_text_of_single_pages():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>'
        '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 0 --><div class="top-ad">Buy</div><div class="cookie-notice">We use</div>'
        "<article class='x'><h1>Head &amp; Title</h1><p><b>Bold\n  one.<br><p>Two&nbsp;&#x41;<i>b</i>c</p><aside>Side</aside><form><input>Mail</form>"
        '<ul><li>i<li>j</ul><section id="comments"><p>Reader says</p></section></article><footer>&copy; host</footer></body></html'
    )
    assert text_of(page) == "Head & Title Bold one. Two Abc i j"
    assert text_of("<div>No marks <a href=x>link</a> here</div><div><a>only links here</a></div><p>end") == "No marks link here end"
    assert text_of("<article>A<ol class='commentlist'><li>r</ol><div id='topNav'>n</div><p class='intro'>B</p></article>") == "A B"
    assert text_of("plain &lt;text&gt;") == "plain <text>"
    assert text_of("") == text_of(None) == ""
    assert text_of("<p>a<!-- unclosed <p>b") == "a"
    assert text_of("<main><article>One two three</article><article>One</article></main>") == "One two three One"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_all_marks_count_and_a_small_one_never_hides_the_rest():
    words = " ".join(f"w{i}" for i in range(100))
    assert text_of(f"<main><h1>T</h1><p>{words}</p><article class='card'>x y</article></main>") == f"T {words} x y"
    assert text_of("<article>A b c</article><p>x</p><article>D</article>") == "A b c D"
    assert text_of("<main><h1>Head</h1><article>One two three four</article></main>") == "Head One two three four"
    assert text_of(f"<div>{words}</div><article>x y</article>") == f"{words} x y"
    assert text_of("<p>Text</p><ul><li><a>one</a></li><li><a>two</a></li></ul><p>see <a>this long page</a>") == "Text one two see this long page"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_names_of_furniture_are_whole_words_and_yield_to_running_text():
    words = " ".join(f"w{i}" for i in range(100))
    for name in ("threads", "downloads", "heads", "roads", "uploads", "commentary", "elementor-widget"):
        assert text_of(f"<article>A<div class='{name}'>B</div></article>") == "A B"
        assert text_of(f"<div class='{name}'><p>B</p></div>") == "B"
    assert text_of("<article class='comment'>Leader</article>") == text_of("<main class='comments'>Leader</main>") == "Leader"
    for name in ("related", "share", "alert", "notice", "search", "widget"):
        assert text_of(f"<article>A<section class='{name}'><h2>H</h2><p>{words}</p></section></article>") == f"A H {words}"
        assert text_of(f"<article>A<section class='{name}'><p>few words</p></section></article>") == "A"
        assert text_of(f"<article>A<section class='{name}'><p><a>{words}</a></p></section></article>") == "A"
    assert text_of(f"<article>A<div class='comments'><article class='comment'>{words}</article></div><div class='ad'>{words}</div></article>") == "A"
    assert text_of("<div class='has-sidebar'><main>Text</main><div class='sidebar'>S</div></div>") == "Text"
    assert text_of(f"<div>{words}</div><div class='sidebar'><article>Teaser</article></div>") == words
    # Constant running text below a name is template, so it does not overrule.
    page = parse(f"<article>A<div class='notice'><p>{words}</p></div></article>")
    assert main_text(page, {id(n) for n in in_order(page) if n.tag == "p"}) == "A"


def tree(rng, depth):
    node = Node("x", rng.choice("ab"), False)
    node.children = [tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return node


def test_alignment_is_as_large_as_brute_force():
    rng = random.Random(1)

    def best(a, b):
        if a.label != b.label:
            return 0

        @lru_cache(None)
        def rest(i, j):
            if i == len(a.children) or j == len(b.children):
                return 0
            return max(rest(i + 1, j), rest(i, j + 1), best(a.children[i], b.children[j]) + rest(i + 1, j + 1))

        return 1 + rest(0, 0)

    for _ in range(200):
        one, other = tree(rng, 3), tree(rng, 3)
        other.label = one.label
        _shape(one)
        _shape(other)
        pairs = align(one, other)
        assert len(pairs) == best(one, other) and all(a.label == b.label for a, b in pairs)
        assert len({id(a) for a, _ in pairs}) == len({id(b) for _, b in pairs}) == len(pairs)
        assert outline(from_outline(outline(one))) == outline(one) and len(in_order(one)) == one.size


def test_constant_nodes_become_template_and_copies_do_not(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(999)) for _ in range(12))
    rows, want = [], {}
    for i in range(20):
        body = [say() for _ in range(rng.randrange(2, 6))]
        rows.append((i, "http://fixed.example/x", "<body><div>Welcome to us</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>All rights</div></body>", 0))
        want[i] = " ".join(body)
    same = "<body><div>Once</div><p>" + say() + "</p></body>"
    rows += [(100 + i, "https://copies.example/", same, 0) for i in range(12)]
    rows += [(200, None, None, 0), (201, "no host", "<p>x</p>", 0), (0, "http://fixed.example/x", rows[0][2], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(4)
    got = extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r.text for r in got}
    assert {i: found[i] for i in want} == want
    assert found[100].startswith("Once ") and found[200] == "" and found[201] == "x"
    assert extract(pages.limit(0)).count() == 0


def test_each_layout_has_its_template_and_one_odd_page_does_not_cancel_it(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(999)) for _ in range(12))
    rows, want = [], {}
    for i in range(40):  # two layouts at half each; every tenth page has another line at the top, the year changes
        body = [say() for _ in range(rng.randrange(1, 5))]
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        top, year = "Sale" if i % 20 == 7 else "Welcome to us", 2020 + i % 5
        one = f"<body><div>{top}</div>{paragraphs}<div>© {year} Host</div></body>"
        other = f"<body><table><tr><td>Top</td></tr></table><section>{paragraphs}</section><section class=x>© {year} Host</section></body>"
        rows.append((i, "http://two.example/x", one if i % 2 else other))
        want[i] = ("Sale " if i % 20 == 7 else "") + " ".join(body)
    rows.append((50, "http://two.example/x", "<body><main>Lone layout</main></body>"))
    want[50] = "Lone layout"
    for i in range(60, 70):  # the same menu of varying links on all pages; the list of links in the text of one page stays
        links = "".join(f"<li><a>{say()}</a></li>" for _ in range(3)) if i == 60 else ""
        text = say()
        rows.append((i, "http://links.example/x", f"<body><div><a>{say()}</a></div><p>{text}</p><ul>{links}</ul><div>Fixed</div></body>"))
        want[i] = " ".join([text, *re.findall("<li><a>(.*?)</a>", links)])
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want
