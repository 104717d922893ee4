"""Search, licences and pages: brute force, and awkward rows."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from spanworks.llm import inner_product, licenses, site_tree
from spanworks.llm.site_tree import Page

VECTORS = "vec_id long, embedding array<float>, label int, score long"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (3 if i % 40 == 0 else 1) for _ in range(12)], 0, 1) for i in range(400)]
    same = [0.5] * 12
    rows += [(i, same, 0, 1) for i in range(400, 560)]  # ties
    rows += [(600, None, 0, 1), (601, [1.0, None], 0, 1), (650, [math.nan] * 12, 0, 1), (700, [math.inf] + [0.0] * 11, 0, 1)]
    rows += [(750, [], 0, 1), (800, [2.0, 3.0], 0, 1), (0, rows[0][1], 0, 1), (33, rows[33][1], 0, 1), (None, same, 0, 1)]
    rows += [(850, [0.0] * 12, 0, 1), (900, [-x for x in rows[40][1]], 0, 1)]
    return spark.createDataFrame(rows, VECTORS)


def top_by_force(rows, k, step):
    numbers = []
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            numbers.append((i, [math.floor(256 * v) for v in x]))
    for q in sorted({i for i, _ in numbers if i % step == 0}):
        x = next(v for i, v in numbers if i == q)
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in numbers if i != q)[:k]
        yield from ((q, n, i, -s) for n, (s, i) in enumerate(scores, 1))


@pytest.mark.parametrize("block,queries,k", [(16, 3, 5), (4096, 512, 5), (64, 8, 1000)])
def test_top_k(vectors, block, queries, k):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = inner_product.top_k(vectors, k=k, block=block, queries=queries).collect()
    assert sorted(tuple(r) for r in got) == list(top_by_force(rows, k, 50))


def test_top_k_of_few(spark):
    assert inner_product.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 0, 0)], VECTORS)
    assert inner_product.top_k(one).count() == 0
    with pytest.raises(Exception, match="too long for scores"):
        inner_product.top_k(spark.createDataFrame([(50, [1e30, 0.0], 0, 0)], VECTORS)).count()


def test_bounds_hold():
    """No pair of the best is ruled out, whatever the rotation."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-400, 400, (2000, 16))
    vectors = vectors[np.argsort(-(vectors**2).sum(1), kind="stable")]
    ids, queries = np.arange(2000), rng.integers(-400, 400, (20, 16))
    rotation = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    best = inner_product.compare(np.full(20, -1), queries, np.full(20, np.iinfo(np.int64).min), ids, vectors, rotation, 5)
    for q, found in zip(queries, best.found):
        assert found == sorted(zip((-(vectors @ q)).tolist(), ids.tolist()))[:5]


FILES = [
    ("a/x/1.py", "Code of many words, one after the other.\nLicensed under the Apache License, Version 2.0.\n" + "more code of this kind\n" * 9), ("a/x/2.py", "no notice at all in this file"),
    ("a/x/y/3.py", None), ("a/LICENSE", "Released under the MIT License."), ("a/b/4.py", ""), ("b/5.py", "all the rights of man"),
    ("a/x/y/z/COPYING.txt", "long words before it\n" * 30 + "All rights reserved."), ("a/x/y/z/6.py", "plain"), (None, "plain"),
    (None, "All rights reserved."), ("7.py", "plain"), ("a/x/2.py", "no notice at all in this file"), ("/r/8.py", "x"), ("/NOTICE", "Licensed under CC BY 4.0."),
]


def test_licences(spark):
    files = spark.createDataFrame([(k, p, t, "s") for k, (p, t) in enumerate(FILES)], "doc_id long, path string, text string, licence_note string")
    rows = {r.doc_id: r for r in licenses.scan(files).collect()}
    assert len(rows) == len(FILES)
    got = [(rows[k].licence, rows[k].inherited_from) for k in range(len(FILES))]
    assert got == [
        ("Apache-2.0", None), ("MIT", "a"), ("MIT", "a"), ("MIT", None), ("MIT", "a"), ("CC-BY-4.0", ""),
        ("all-rights-reserved", None), ("all-rights-reserved", "a/x/y/z"), (None, None), ("all-rights-reserved", None), ("CC-BY-4.0", ""),
        ("MIT", "a"), ("CC-BY-4.0", ""), ("CC-BY-4.0", None)]
    assert rows[0].licence_note == "s"
    empty = files.limit(0)
    assert licenses.scan(empty).count() == 0


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""
BSD_HEADER = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
"""
NOTICES = [
    ("This is under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 7.0.", None), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), (" * SPDX-License-Identifier: MIT", "MIT"),
    *((GPL_HEADER.format(kind, version), label) for kind, version, label in (
        ("", 2, "GPL-2.0"), ("", 3, "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", 3, "LGPL-3.0"), ("Affero ", 3, "AGPL-3.0"))),
    (BSD_HEADER, "BSD"), (BSD_HEADER + " * 1. in source\n * 2. in binary form must reproduce", "BSD-2-Clause"),
    (BSD_HEADER + " * 1. in source\n * 2. in binary form must reproduce\n * 3. Neither the name of the", "BSD-3-Clause"),
]


def test_wrapped_notices_and_variants(spark):
    """Headers over several comment lines of a long file, and variants and versions told apart."""
    code = "".join(f"x{k} = call_of({k}, some other words)\n" for k in range(300))
    rows = [(k, f"d{k}/f", notice + "\n" + code) for k, (notice, _) in enumerate(NOTICES)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(files).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [label for _, label in NOTICES]


def test_whole_licence_texts(spark):
    """Every whole text is known, speaks for its directory, and is not taken for another one."""
    texts = dict(licenses.TEXTS)
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL", 1)
    texts["BSD-2-Clause"] = texts.pop("BSD")
    rows = [row for label, t in texts.items() for row in ((f"{label}/text", t), (f"{label}/sub/code", "plain words"))]
    files = spark.createDataFrame(rows, "path string, text string")
    for r in licenses.scan(files).collect():
        assert r.licence == r.path.split("/")[0]
        assert (r.inherited_from is None) == r.path.endswith("text")


def test_cosines_by_force(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def terms(text):
        out = []
        for w in word.findall(text.lower()):
            for _ in range(4):
                w = w[:-1] if len(w) > 1 and w[-1] in signs else w
                w = w[1:] if len(w) > 1 and w[0] in signs else w
            out.append(w)
        return out

    lines = [line for _, t in FILES for line in (t or "").split("\n") if word.search(line)]
    vocabulary = {w for _, t in licenses.TEMPLATES for w in terms(t)}
    seen = Counter(w for line in lines for w in set(terms(line)) & vocabulary)
    idf = {w: math.log((1 + len(lines)) / (1 + seen[w])) + 1 for w in vocabulary}
    unseen = math.log(1 + len(lines)) + 1

    def cosine(a, b):
        x, y = Counter(w for w in terms(a) if w in vocabulary), Counter(terms(b))
        other = sum(w not in vocabulary for w in terms(a))
        dot = sum(x[w] * y[w] * idf[w] ** 2 for w in x)
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in x.items()) + other * unseen**2)
        return dot / max(length * math.sqrt(sum((n * idf[w]) ** 2 for w, n in y.items())), 1e-12)

    files = spark.createDataFrame([(str(k), t) for k, (_, t) in enumerate(FILES)], "path string, text string")
    for r in licenses.scan(files, similarity=0.0).collect():
        own = [line for line in (FILES[int(r.path)][1] or "").split("\n") if word.search(line)]
        best = max((cosine(line, t) for line in own for _, t in licenses.TEMPLATES), default=0.0)
        assert abs(r.own_similarity - best) < 1e-9


PAGES = [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div>x <b>y</b>z</div><nav>n</nav>", "x yz"),
    ("a &lt; b &amp; c<br>d &amp", "a < b & c d &"), ('<p>cut off <a href="x', "cut off"), ("<p>1 < 2</p>", "1 < 2"),
    ("<article><p>t</p><div class='ad'>no</div><section id=comments><p>c</p></section></article>after", "t"),
    ("<script>var a='</p>';</script>ok<style>p{}</style>", "ok"), ("<!-- c <p>x</p> -->k", "k"), ("<textarea><p>x</p></textarea>y", "y"),
    ("<body><header>h</header><main><header><h1>T</h1></header><p>q</p><footer>f</footer></main></body>", "T\n\nq"),
    ("<article><p>a</p><aside>s</aside>tail</article>", "a\n\ntail"), ("<ul><li>a<li>b</ul>c", "a\n\nb\n\nc"),
    ("<p>a\xa0 b&nbsp;c\n\td</p>", "a b c d"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<div role=navigation>n</div><div class='cookie-notice'>k</div>t</div></p>", "t"), ("<article></article>", ""),
    ("<body class='has-sidebar modal-open'><article><p>t</p></article></body>", "t"), ("<body class=sidebar><p>t</p></body>", "t"),
    ("<div id=content-with-sidebar><article class='post category-advertising'><p>t</p></article></div>", "t"),
    ("<article class='ad widget'><p>t</p></article>", "t"), ("<div class='sidebar-open'><p>t</p></div>", "t"),
    ("<div class=sidebar><main class=widget><p>t</p></main>s</div>x", "t"),
    ("<div class='widget wide'><p>w</p><article><p>The text.</p><div class=share>s</div></article></div>x", "The text."),
    ("<article><p>t</p></article><div id=comments><article><p>A comment, longer.</p></article></div>", "t"),
    ("<div class=related><article>r</article></div><p>Without a mark.</p>", "Without a mark."),
    ("<div class=sidebar-left>s</div><div class=site-footer>f</div><div class='main_nav top-ad'>n</div><p class=shared-memory>t</p>", "t"),
    ("<article role=main class=nav><p>t</p></article>", "t"), ("<div class=sticky-header><p>h</p></div><p>t</p>", "t"),
    ("<article><h2 id='social-contract-theory'>H</h2><h2 id=\"share-prices-fall\">S</h2><p>t</p></article>", "H\n\nS\n\nt"),
    ("<article><section id=comments-on-the-act><p>c</p></section></article>", "c"),
    ("<article><section id='related-work'><p>r</p></section></article>", "r"), ("<p data-id='notice' data-class=ad data-role=menu>x</p>", "x"),
    ("<p title='the class=notice id=ad'>x</p><p\n\tclass\n=\n'ad'>y</p>", "x"), ("<p class='ad'id=x>y</p>z", "z"),
    ("<article><h2 id=share>Share</h2><p class='big notice'>n</p><div class='share-prices'>k</div><div id=comments>c</div></article>", "Share\n\nk"),
    ("<p>&#233;&#x4e2d;</p>", "é中"), ("<title>t</title><form>f<input></form><p>x</p>", "x"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_page(html, text):
    assert Page(html, with_nodes=True).text() == text


def test_site_tree(spark):
    """A site's own branch goes by its entropy, though nothing names it; what differs stays."""
    rng = random.Random(4)
    rows = []
    for k in range(30):
        own = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(20))
        box = "<div class=q1><p>Call us today</p></div>"
        rows.append((k, f"https://one.example/{k}", f"<body>{box}<div class=q2><p>{own}</p></div></body>", own))
        rows.append((100 + k, f"http://two.example:80/{k}", f"<article><p>Same in all.</p><p>{own}</p></article>", f"Same in all.\n\n{own}"))
    rows += [(200, "http://few.example/", "<div class=q1>Call us</div>x", "Call us\n\nx"), (201, None, "<p>n</p>", "n"), (202, "odd", None, "")]
    rows += [(200, "http://few.example/", "<div class=q1>Call us</div>x", "Call us\n\nx"), (None, "http://few.example/", "a", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = site_tree.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter((i, u, t, len(t)) for i, u, _, t in rows)
    assert site_tree.extract(pages.limit(0)).count() == 0


def test_site_tree_in_marked_text(spark):
    """A branch with a class that repeats goes from marked text too; prose that repeats, and copies of one page, stay."""
    rng = random.Random(5)
    rows = []
    for k in range(30):
        own = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(20))
        box = "<div class=q1><p>Call us today</p></div>"
        rows.append((k, f"https://one.example/{k}", f"<main>{box}<div class=q2><p>{own}</p></div><p>Same.</p></main>", f"{own}\n\nSame."))
        rows.append((100 + k, f"https://two.example/{k}", f"<body><article>{box}<p>Same.</p></article></body>", "Same."))
        rows.append((200 + k, f"https://three.example/{k}", f"<body><div class=q3><article>{box}</article></div></body>", "Call us today"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in site_tree.extract(pages).collect()} == {i: t for i, _, _, t in rows}


def test_long_and_broken_pages():
    assert Page("<div>" * 20_000 + "x").text() == "x"
    assert Page("<p " + "a='" * 50_000).text() == ""
    start = time.perf_counter()
    assert Page("<div class=a>" * 20_000 + "x" + "</div>" * 20_000, with_nodes=True).text() == "x"
    assert Page("<ul><li class=b>x" * 10_000, with_nodes=True).text().count("x") == 10_000
    assert time.perf_counter() - start < 4  # in proportion to the length of the page
    assert len(Page("<p>word " * 100_000).blocks) == 100_000
