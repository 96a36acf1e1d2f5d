"""Markup: trees, infoboxes, grids and washing on cases the tables do not hold."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.functions import markup as M

PAGE = """<h1>Star <b>Platinum</b></h1><h3>User</h3> x <div>A. One<br>B. Two [1]</div><h3>User</h3><div>later</div><h3>Type citation needed</h3><div>Close &amp; near</div>
<h3>Origin</h3><div>%s</div><h3>Awakening</h3><h3>Else</h3><div>no</div>
<table><tr><td class="pi-data-value" data-source="speed">ignored? no</td><td><table><tr><td class="x pi-data-value" data-source="range">C
<tr><td class="pi-data-value" data-source="range"> </td></table></td></tr>
<tr><td class="pi-data-value" data-source="speed">B<td class="pi-data-value" data-source="range">∞<td class="pi-data-value" data-source="stamina">A<td class="pi-data-value" data-source="potential">Ｅ[a]</table>
<section class="pi-item pi-group"><th class="pi-data-label">no</th><th>ACT1</th></section><section class="pi-group"><table><tr><th>Speed</th></table></section>""" % ("long " * 100)


def test_infobox():
    box = M.infobox(PAGE)
    assert box["name"] == "Star" and box["fields"] == {"owner": "A. One, B. Two", "stand_type": "Close & near", "awakening": "Else"}
    assert box["forms"] == [{"label": "ACT1", "values": {"SPD": "ignored? no", "RNG": "C"}}, {"label": "form_1", "values": {"SPD": "B", "RNG": "∞", "STA": "A", "DEV": "E"}}]
    assert M.infobox(None) == {"name": "", "fields": {}, "forms": []} == M.infobox("</div></td><p")
    assert M.infobox('<td class="pi-data-value" data-source="speed">A</td>' * 2)["forms"] == [{"label": "form_0", "values": {"SPD": "A"}}]


def test_grids():
    html = '<table><thead><tr><th colspan=2>a<th>b</thead><tbody><tr><td rowspan="2">c<td>d<br>e<td>f<table><tr><td>in</table><tr><td rowspan=9>g</tbody><tr><td colspan="x">h<td>i</table>'
    assert M.grids(html) == [[["a", "a", "b"], ["c", "d e", "f"], ["c", "g"], ["h", "g", "i"]], [["in"]]]
    assert M.grids("none") == [] and M.grids("<table></table>") == [[]]


def test_rendered():
    page = M.rendered("<nav><li>x</nav><h1>N</h1><p>one<p>two <b>bold</b><ul><li>no</ul><h2>Head</h2><div><p>three</div><ul><li>a<li>b<br>c</ul><ol></ol><footer><p>gone</footer>")
    assert page == {"name": "N", "overview": ["one", "two bold"], "sections": [{"heading": "Head", "paras": ["three"], "lists": [["a", "b c"]]}]}


def test_washed():
    text = "A<!-- c --> {{nihongo|B {{ruby|C|c}}|x}} {{drop|y {{lang|z}}}}<ref name=a/>D<ref>no</ref><gallery>no</gallery> <b>E</b>\n==  Head ==\n* [[X|F]] [[G]] [[File:no|no]] [http://u v w] [http://u]\n{| no {| no |} |}'''H'''\n\n\n\n: I <!-- open"
    assert M.washed(text) == "A B C D E\n\n## Head\n\n- F G v w\nH\n\n- I <!-- open"
    assert M.washed(None) == "" and M.washed("a {{lang|b") == "a" and M.washed("a }} | b") == "a }} | b"


MARKS = st.lists(st.sampled_from(["{{", "}}", "|", "lang", "x", " ", "{|", "|}", "<ref>", "</ref>", "<!--", "-->", "[[", "]]", "==", "\n", "*"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(MARKS)
def test_washing_properties(text):
    def innermost(t):  # rewriting of the innermost template first, by search
        while (m := re.search(r"\{\{((?:(?!\{\{|\}\})[\s\S])*)\}\}", t)) :
            name, *rest = m[1].split("|")
            t = t[: m.start()] + (rest[0].strip() if name.strip().lower() in M.KEPT_TEMPLATES and rest else "") + t[m.end() :]
        return t

    if "{{{" not in text and "}}}" not in text:
        got, want = M.rewritten_templates(text), innermost(text)
        if "{{" not in want:
            assert got == want
    out = M.washed(text)
    assert "{{" not in M.rewritten_templates(text) and M.washed(out).count("\n\n\n") == 0 and out == out.strip()


def test_washing_is_linear():
    import time

    def spent(n):
        began = time.perf_counter()
        for mark in ("{{a|", "<!--", "<ref>", "[[", "{|", "<gallery>", "'", "=="):
            M.washed(mark * n)
        return time.perf_counter() - began

    spent(2000)
    assert spent(40_000) < 60 * max(spent(2000), 0.01)


def test_sections():
    text = "lead\n\n" + "a" * 500 + "\n\n" + "b" * 500 + "\n## T\nshort\n\nmore\n## Empty\n\n## U\n" + "c" * 1000 + "\n\n" + "d" * 10
    got = M.sections(text)
    assert got == [
        {"section": "", "content": "lead\n\n" + "a" * 500},
        {"section": "", "content": "b" * 500 + "\n\nshort\n\nmore"},
        {"section": "U", "content": "U\n" + "c" * 1000},
        {"section": "U", "content": "U\n" + "d" * 10},
    ]
    assert M.sections(None) == [] == M.sections(" \n")
