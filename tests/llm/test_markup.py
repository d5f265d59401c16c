import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import markup as M

PLAIN = [
    "- Who is there?\n- Nobody.", "F***, d**n!", "Wait *** here. ***", "80 < 94 > 79.", "15*16 = 240", "I <3 you", "#38: at last", "Tom & Anna", "file_take_76.srt: go",
    "It is $20 + $239.", "♪ la la ♪", "[Anna laughs] Yes.", "R&D and AT&T", "C:\\temp\\new", "snake_case_name", "a < b", "3. Mai", "x = y == z", "", " ", "1 * 2 * 3", "*",
]
MARKED = {
    "<i>Hello</i> there": "Hello there",
    "Hello</i>": "Hello",
    "<I>Hello": "Hello",
    "Tom &amp; Anna": "Tom & Anna",
    "&lt x &lt; y": "&lt x < y",
    "a &amp &amp; z": "a &amp & z",
    "{\\an8}{\\i1}Up{\\i0}": "Up",
    "{y:i}Up": "Up",
    "**bold** and *it* and ~~gone~~": "bold and it and gone",
    "学校の*猫*です": "学校の猫です",
    "''it'' and '''bold'''": "it and bold",
    "## Head\ntext": "¶ Head\ntext",
    "== Head ==\ntext": "¶ Head\ntext",
    "== A long\nhead ==\ntext": "¶ A long\nhead\ntext",
    "1. one\n2. two": "1) one\n2) two",
    "* one\n* two": "• one\n• two",
    "> quoted": "│ quoted",
    "see `a < b` now": "see ⟨a < b⟩ now",
    "x\n```py\na = <b>\n```\ny": "x\n    a = <b>\ny",
    "x $a^2$ y": "x ⟦a^2⟧ y",
    "x \\(a<b\\) y": "x ⟦a<b⟧ y",
    "[text](http://a.example/1) here": "text here",
    "[[Page|label]] and [[word]]": "label and word",
    "a{{note|{{b}}|c}} d": "a d",
    "\\section{Head} text \\textbf{bold}": "¶ Head\ntext bold",
    "\\begin{itemize}\n\\item one\n\\end{itemize}": "• one",
    "<ul><li>one</li><li>two</li></ul>": "• one\n• two",
    "<h2>T</h2><pre>a[1] &lt;&lt; 2</pre>": "¶ T\n    a[1] << 2",
    "cut **off": "cut off",
    "cut [[off": "cut off",
    "cut \\textbf{off": "cut off",
    "{\\em word} x": "word x",
    "&amp;lt;": "&lt;",
    "&#42;a&#42;": "*a*",
}


@pytest.mark.parametrize("t", PLAIN)
def test_ordinary_captions_are_no_markup(t):
    assert M.clean(t) == (t, False)


@pytest.mark.parametrize("t", MARKED)
def test_markup(t):
    import re

    assert M.clean(t) == (MARKED[t], True)
    assert re.search(M.CANDIDATE, t)


def test_spans_have_no_limit():
    w = "w " * 4000
    for a, b in (("`", "`"), ("$x^", "$"), ("\\(", "\\)"), ("*", "*"), ("**", "**"), ("_", "_"), ("'''", "'''"), ("{{", "}}"), ("[[", "]]"), ("\\begin{align}", "\\end{align}"), ("```\n", "\n```")):
        t = f"x {a}{w.strip()}{b} y" if a[0:3] != "```" else f"x\n{a}{w.strip()}{b}\ny"
        got, found = M.clean(t)
        assert found and a not in got, a
    assert M.clean("a" + "{{b " * 50 + "}}" * 50 + " c") == ("a c", True)
    assert M.clean("\\textbf{" * 50 + "a" + "}" * 50) == ("a", True)
    assert M.clean("[[" * 30 + "a" + "]]" * 30) == ("a", True)
    assert M.clean("".join(f"`c{i}` $x^{i}$ " for i in range(500)))[0].count("⟨") == 500


@pytest.mark.parametrize("unit", ["<a ", "<", "*a ", "**a ", "{{", "[[a", "`a ", "$a ", "\\(", "\\a[", "\\ab{", "{\\", "&amp", "''a ", "](", "== a\n", "<!--", "</", "_a ", "```\n", "<a href='", "[", "| a |\n", "> "])
def test_time_grows_with_the_text(unit):
    def took(n):
        t = unit * n
        s = time.perf_counter()
        M.clean(t)
        return time.perf_counter() - s

    took(50)
    assert took(20000) < 60 * max(took(2000), 0.004), unit


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab *_`$<>/{}[]|\\'~&;#=\n()!i", max_size=60))
def test_any_text(t):
    got, found = M.clean(t)
    assert found or got == t
    assert not M._MARKS.search(got)


def test_navigation_goes_and_text_stays():
    nav = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    body = "".join(f"<p>{'A long line of running text that says something. ' * 4}</p>" for _ in range(6))
    got = M.clean(f"<ul>{nav}</ul>{body}")[0]
    assert "Item 2" not in got and got.count("A long line") == 24
    assert M.clean("<p>short</p><ul><li>one</li></ul>")[0] == "short\n• one"


def test_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "<b>x</b>", "k"), (3, "<b>x</b>", "k"), (4, "plain", None)]
    df = spark.createDataFrame(rows, "sub_id long, text string, clean string")
    assert sorted((r["sub_id"], r["clean"]) for r in M.strip_markup(df, "text").collect()) == [(3, "x"), (3, "x")]
    assert M.strip_markup(df.limit(0), "text").count() == 0
