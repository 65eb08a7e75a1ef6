"""Main text of pages with known text: what earlier rounds got wrong, then precision and recall on pages that the tree was not grown on."""

import pytest

P = "<p>" + "This is a long paragraph of the article, with many words in it that go on and on for some time. " * 2 + "</p>"
T = " ".join(P[3:-4].split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<main class='site-main has-sidebar'>{P}</main>", T),
        (f"<article class='legal-article'>{P}</article>", T),
        (f"<article>{P}</article><footer><div class='content'>{P}</div></footer>", T),
        (f"<article>{P}</article><div class='sidebar'><div class='content'>{P}</div></div>", T),
        (f"<article>{P}</article><div id=comments><div class='entry'>{P}</div></div>", T),
        (f"<article>{P}</article><ol class='comment-list'><li class='comment'><div class='comment-content'>{P}</div></ol>", T),
        (f"<article><header><h1>A title</h1></header>{P}</article>", "A title " + T),
        (f"<article>{P}<div style='display:none'>{P}</div><div hidden>x y z</div><p aria-hidden=\"true\">no</p></article>", T),
        ("<article><p>Some words <span class='ad'>buy <span>me</span> now</span> and <em>more</em> text.</p></article>", "Some words and more text."),
        (f"<form id=aspnetForm><div class='nav'>x</div><main>{P}</main></form>", T),
        (f"<article>{P}<form>Name <input> {P}</form></article>", T),
        (f"<body class='no-sidebar'><div class='site-header'>{P}</div><div class='post-content'>{P}</div><div class='related-posts'>{P}</div>", T),
    ],
)
def test_marks(page, want):
    from skipscan.llm import html

    assert html.main_text(page, html.grow(html.LABELLED)) == want


#: (page without marks, its blocks of main text): neighbours decide.
PLAIN = [
    ("<div><a href=/>Home</a></div><div><a href=/a>About</a></div><h1>How rivers find their way to the sea</h1>" + P * 3 + "<h2>The delta</h2>" + P * 2 + "<div><a href=/x>Older</a></div><div>Copyright 2021</div>", ["How rivers find their way to the sea", T, T, T, "The delta", T, T]),
    ("<table><tr><td><a href=1>One</a><td><a href=2>Two</a></table>" + P + "<ul><li>first point of the list<li>second point of the list</ul>" + P + "<div><a href=z>Back to top</a></div>", [T, "first point of the list", "second point of the list", T]),
    ("<div>Sign up</div><div><a href=1>Log in</a></div>" + P * 2 + "<div><a href=2>Share this</a> <a href=3>Print</a></div><div>All rights reserved</div>", [T, T]),
    ("<div><a href=1>News</a> <a href=2>Sport</a></div><h1>Rain expected across the north on Monday</h1><div>By A. Writer</div>" + P * 4 + "<div>More stories</div><div><a href=4>Sun in the south</a></div><div><a href=5>Snow on the hills</a></div>", ["Rain expected across the north on Monday", "By A. Writer", T, T, T, T]),
    (P, [T]),
    ("<div><a href=1>a</a></div><div><a href=2>b</a></div><div><a href=3>c</a></div>", []),
    ("<div>Menu</div><div><a href=1>Home</a></div><div>" + T + "</div><div>A short line between.</div><div>" + T + "</div><div><a href=9>Contact</a></div>", [T, "A short line between.", T]),
]


def test_precision_and_recall_without_marks():
    from skipscan.llm import html

    tree, hit, made, meant = html.grow(html.LABELLED), 0, 0, 0
    for page, want in PLAIN:
        got, sought = html.main_text(page, tree).split(), " ".join(want).split()
        left = sorted(got)
        common = 0
        for w in sought:
            if w in left:
                left.remove(w)
                common += 1
        hit, made, meant = hit + common, made + len(got), meant + len(sought)
    print("precision", hit / made, "recall", hit / meant)
    assert hit / made >= 0.97 and hit / meant >= 0.97
