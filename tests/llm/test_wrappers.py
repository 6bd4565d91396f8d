"""Wrapper induction: tree matching against brute force, regions without names, and deep or hostile pages."""

import random

from quorumlens.llm import dom, extraction


def brute_weight(template, slot, nodes):
    """Simple tree matching by its definition: the best order-keeping pairing of folded children, tried recursively."""
    runs, kids = dom.runs_of(nodes), template.children[slot]

    def best(i, j):
        if i == len(kids) or j == len(runs):
            return 0
        out = max(best(i + 1, j), best(i, j + 1))
        if template.labels[kids[i]] == runs[j][0]:
            out = max(out, brute_weight(template, kids[i], runs[j][1]) + best(i + 1, j + 1))
        return out

    return 1 + best(0, 0)


def random_page(r, depth=0):
    if depth == 4:
        return "x"
    tags = ("div", "ul", "li", "section", "p", "table")
    return "".join(f"<{t}>{random_page(r, depth + 1) if t not in ('p',) else 'x'}</{t}>" for t in (r.choice(tags) for _ in range(r.randint(0, 3))))


def test_matching_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        a, b = dom.parse(random_page(r)), dom.parse(random_page(r))
        t = dom.Template.of(a)
        assert t.align(b) == brute_weight(t, 0, [b.root])
        assert all(n.at() >= 0 for n, _ in b.blocks)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def extract(spark, rows):
    return {r["page_id"]: r["text"] for r in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_regions_without_any_names(spark):
    """Menus, adverts and footers that differ on every page, in elements that say nothing, next to articles of any length."""
    r, rows, want = random.Random(7), [], {}
    for i in range(12):
        heads, body = words(r, 4), [words(r, 1 if i == 3 else 60) for _ in range(1 if i == 3 else r.randint(2, 4))]
        menu = "".join(f"<li>{words(r, 1)}</li>" for _ in range(6))
        rows.append((i, f"http://plain.example/{i}", f"<body><div><ul>{menu}</ul></div><div>{words(r, 9)}</div><div><h1>{heads}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>{words(r, 8)}</div></body>"))
        want[i] = "\n".join([heads, *body])
    assert extract(spark, rows) == want


def test_constant_blocks_of_two_pages(spark):
    """Two pages are enough to tell what stays the same; copies of a page are one page."""
    page = lambda a: f"<body><div><p>Same on both pages of this host</p><p>{a}</p></div></body>"
    rows = [(1, "http://two.example/a", page("one text")), (2, "http://two.example/b", page("another text")), (3, "http://copy.example/", page("copied")), (4, "http://copy.example/2", page("copied"))]
    both = "Same on both pages of this host\ncopied"
    assert extract(spark, rows) == {1: "one text", 2: "another text", 3: both, 4: both}


def test_names_decide_inside_the_region(spark):
    page = lambda i: f'<body><article><h1>T{i}</h1><p>text {i} and more of it</p><div class="comments"><p>comment {i}</p></div><aside>ad {i}</aside></article></body>'
    assert extract(spark, [(i, "http://c.example/", page(i)) for i in range(4)]) == {i: f"T{i}\ntext {i} and more of it" for i in range(4)}


def test_deep_menus_stay_out(spark):
    """An element's name counts at any depth."""
    deep = "<div>" * 200
    rows = [(1, "http://d.example/", f"<body>{deep}<nav>MENU</nav><p>article text</p>")]
    assert extract(spark, rows) == {1: "article text"}


def test_clashing_names_nulls_and_long_pages(spark):
    long = " ".join(["wort"] * 200_000)
    rows = [(1, None, None, "a"), (2, "x", f"<p>{long}</p>", "b"), (2, "x", f"<p>{long}</p>", "b"), (None, "x", "", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, _host string").withColumnRenamed("_host", "_blocks")
    out = sorted(((r["page_id"] or 0, r["n_chars"], r["_blocks"]) for r in extraction.extract_text(d).collect()), key=str)
    assert out == sorted([(1, 0, "a"), (2, len(long), "b"), (2, len(long), "b"), (0, 0, None)], key=str)


def test_query(spark, tmp_path):
    rows = [(i, f"http://q.example/{i}", f"<body><nav>Menu {i}</nav><article><h1>H&amp;{i}</h1><p>a\n b {i}</article>") for i in range(5)] + [(9, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extraction.op1_wrapper_induction(spark, str(tmp_path)).collect()}
    want = {i: (f"http://q.example/{i}", f"H&{i}\na b {i}", len(f"H&{i}\na b {i}")) for i in range(5)}
    assert got == {**want, 9: (None, "", 0)}
