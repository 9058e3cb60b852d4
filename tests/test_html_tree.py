"""Tolerant page reading against hand-written cases and against a version that builds a tree and walks it."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import html
from matchloom.functions.html_tree import text_nodes


def lines(page):
    return [x for x in (n.strip() for n in text_nodes(page).split("\n")) if x]


@pytest.mark.parametrize(("page", "want"), [
    ("<div><form>f</div><p>kept</p>", ["kept"]),
    ("<div><nav>n<p>m</div>after", ["after"]),
    ("<body><header>h</body>tail", ["tail"]),
    ("<nav>all of it is lost", []),
    ("<nav><nav>x</nav>y</nav>z", ["z"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<ul><li><nav>x<li>y</ul>z", ["z"]),  # li ends only an innermost li
    ("<p>a<div>b</p>c</div>d", ["a", "b", "c", "d"]),
    ("<table><tr><td><form>f<td>g</table>h", ["h"]),
    ("<table><tr><td><form>f</td><td>g</table>h", ["g", "h"]),
    ("<form><div>f</form>g</div>h", []),  # a form's end does not reach over the div, and the div's end does not close the form
    ("<div><form><div>f</div></div>g", ["g"]),
    ("<main>m<article>a</main>b", ["m", "a"]),
    ("<nav><main>x</main></nav><main>y</main><main>z</main>", ["y"]),
    ("<article>a<main>m", ["m"]),
    ("<article>a</div>b</span></article>c", ["a", "b"]),
    ("<title>t<p>x", ["x"]), ("<head><title>t</title></head>x<title>u</title>", ["x", "u"]),
    ("a <b>b</b> 1 < 2 <3 and </ 4", ["a", "b", "1 < 2 <3 and </ 4"]),
    ("x<script>if (a</b) '<p>'</SCRIPT >y", ["x", "y"]), ("x<style>all {", ["x"]),
    ("x<svg/>y<svg>z</svg>", ["x", "y"]), ("x<!-- never closed > y", ["x", "y"]), ("x<a href='", ["x<a href='"]), ("", []), ("x<!DOCTYPE html>y", ["x", "y"]),
    ("<FORM>a</Form>b", ["b"]), ("<br></br>a<img><hr>b</hr>", ["a", "b"]),
])
def test_as_a_tolerant_parser_closes(page, want):
    assert lines(page) == want


def test_through_spark(spark):
    pages = ["<div><form>f</div><p>k&eacute;pt &#38; sound</p>", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", html.posting_text(F.col("h")).alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {0: "képt & sound", 1: None, 2: ""}


@pytest.mark.parametrize("page", [
    "<b>" * 50_000 + "x" + "</i>" * 50_000, "<div><nav>" * 25_000 + "x" + "</div>" * 25_000, "<p>x" * 50_000, "<" * 300_000, "<a " * 100_000, "<!--" * 100_000,
    "<!-- -->" * 50_000, "<ul><li>" * 25_000 + "</ul>" * 25_000, '<a b="' * 50_000, "<script>" * 50_000, "</main>" * 50_000, "<td><div>" * 20_000 + "</td>" * 20_000,
])
def test_time_follows_the_length(page):
    start = time.perf_counter()
    text_nodes(page)
    assert time.perf_counter() - start < 5


class Node:
    def __init__(self, name, parent):
        self.name, self.parent, self.children = name, parent, []

    def texts(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.name not in V.DROPPED_TAGS:
                yield from c.texts()

    def find(self, name):
        for c in self.children:
            if not isinstance(c, str) and c.name not in V.DROPPED_TAGS:
                if c.name == name:
                    return c
                if (got := c.find(name)) is not None:
                    return got
        return None


def by_tree(tokens):
    """The same rules over a tree of nodes, for tokens without heads, titles and raw text."""
    root = here = Node("", None)
    for t in tokens:
        m = re.fullmatch(r"<(/?)(\w+)>", t)
        if m is None:
            here.children.append(t)
        elif not m[1]:
            while here.name in V.IMPLIED_ENDS.get(m[2], ()):
                here = here.parent
            node = Node(m[2], here)
            here.children.append(node)
            if m[2] not in V.VOID_TAGS:
                here = node
        else:
            up = here
            while up.parent and up.name != m[2] and V.END_REACH.get(up.name, 100) <= V.END_REACH.get(m[2], 100):
                up = up.parent
            if up.parent and up.name == m[2]:
                here = up.parent
    chosen = root.find("main") or root.find("article") or root
    return list(chosen.texts())


def test_same_nodes_as_a_tree():
    rnd = random.Random(8)
    names = ["div", "p", "form", "nav", "ul", "li", "span", "table", "tr", "td", "main", "article", "br", "header", "tbody", "dt", "dd"]
    for k in range(3000):
        tokens = [f"t{i}" if rnd.random() < 0.4 else f"<{'/' * (rnd.random() < 0.45)}{rnd.choice(names[: 4 + k % 14])}>" for i in range(rnd.randint(1, 40))]
        merged = []
        for t in tokens:
            if merged and t[0] == "t" and merged[-1][0] == "t":
                merged[-1] += t
            else:
                merged.append(t)
        assert lines("".join(merged)) == by_tree(merged), merged
