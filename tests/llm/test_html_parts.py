"""Which parts of a page are its article, and pages nested without end."""

import time

import pytest

from maskloom.llm.html_text import main_text

P = "This is a paragraph of the article, with commas, and enough words to count for something here."
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<main><article><h1>One</h1><p>{P}</p></article><article><h1>Two</h1><p>{P}</p><p>{P}</p></article></main>", ["One", P, "Two", P, P]),
        (f"<main><article><h1>One</h1><p>{P}</p></article><article><h2><a href=1>Another page</a></h2><p>Short.</p></article></main>", ["One", P]),
        (f"<div><div><h2>A</h2><p>{P} {P} {P}</p></div><div><h2>B</h2><p>Short second section, but text.</p><ul><li>one</li><li>two</li></ul></div><h2>C</h2><p>Third.</p><ul><li>plain</li></ul></div>", ["A", f"{P} {P} {P}", "B", "Short second section, but text.", "one", "two", "C", "Third.", "plain"]),
        (f"<div><div><div><p>{P} {P}</p></div></div><div><div><h3>Next</h3><p>{P} {P}</p></div></div></div>", [f"{P} {P}", "Next", f"{P} {P}"]),
        (f"<article><p>{P}</p><p class='related'>Related work is told of here.</p><p class='notice'>Mind the gap.</p><div class='related'>More: {P}</div></article>", [P, "Related work is told of here.", "Mind the gap."]),
        (f"<article><p>{P}</p><h2>References</h2><ol><li><a href=1>Smith</a></li><li><a href=2>Jones</a></li><li><a href=3>Doe</a></li></ol></article>", [P, "References", "Smith", "Jones", "Doe"]),
        (f"<article><p>{P}</p><ul class='references'><li><a href=1>Smith</a></li><li><a href=2>Jones</a></li><li><a href=3>Doe</a></li></ul>{MENU}</article>", [P, "Smith", "Jones", "Doe"]),
        (f"<article><p>{P}</p>{MENU}</article>", [P]),
        (f"<article><p>{P}</p><p class='sponsored'>Buy this.</p></article>", [P]),
        (f"<body><div><p>{P} {P}</p></div><div>© 2024 A Company of the World, all rights reserved everywhere</div>{MENU}</body>", [f"{P} {P}"]),
    ],
)
def test_parts(page, want):
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x" + "<p>y" * 20_000, "<b><p>x" * 20_000, "<div>" * 30_000 + "x" + "<p>y" * 30_000, "<span>" * 20_000 + "<li>y" * 20_000, "<table><tr>" + "<td>a" * 30_000, "<ul><li>" * 10_000, "<h2>Sources</h2><ul><li><a href=1>x</a>" * 10_000])
def test_pages_nested_without_end(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4
