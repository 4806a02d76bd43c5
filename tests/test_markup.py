"""Selectors against expected texts, errors on what is not known, and ends that starts imply."""

import pytest

from pacegrid.operators import markup

PAGE = '<div id=m class="a b"><ul><li><a href="/e1">A</a><li class=x><a href="http://q/E2.pdf">B</a><li>C<ul><li>D</ul><li>E</ul><p>one<p>two<div>three</div></div><table><tr><td>1<td>2<tr><td>3</table>'
CASES = {
    "ul > li": "A|B|C D|D|E", "div > ul > li:nth-child(2)": "B", 'a[href^="/e"]': "A", "a[href$='.PDF' i]": "B", "a[href*=q]": "B", "li + li": "B|C D|E", "li ~ li.x": "B", "li:not(.x):not(:first-child)": "C D|E", "#m > p": "one|two",
    "td": "1|2|3", "tr:last-child td": "3", "li:nth-child(odd)": "A|C D|D", "li:nth-child(-n+2)": "A|B|D", "li:nth-last-child(1)": "D|E", "ul ul, p": "D|one|two", "*[class~=b] > p": "one|two", "div p + p": "two", "li:not(ul ul li)": "A|B|C D|E",
    "li:only-child": "D", "[class|=x]": "B", "LI.x": "B", "ul>li>a": "A|B", "li:nth-child(2n + 1) > a": "A", "[href]": "A|B", '[href=""]': "", '[class^=""]': "",
}


@pytest.mark.parametrize(("selector", "texts"), CASES.items())
def test_selectors(selector, texts):
    assert [x.text() for x in markup.select(markup.parse(PAGE), selector)] == [x for x in texts.split("|") if x]


@pytest.mark.parametrize("selector", ["li::before", "a:hover", "> li", "li >", "a,,b", "li:nth-child(x)", "a[", "li:not(", ".a:b(", "", "a b, "])
def test_unknown_syntax_is_an_error(selector):
    with pytest.raises(ValueError, match="selector|in ''|children|unknown|nothing|bracket"):
        list(markup.select(markup.parse(PAGE), selector))


def test_implied_ends():
    text = lambda html, s: [x.text() for x in markup.select(markup.parse(html), s)]
    assert text("<li>C<li>D", "li") == ["C", "D"]
    assert text("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dd") == ["b", "d"]
    assert text("<select><option>a<option>b</select>", "option") == ["a", "b"]
    assert text("<table><thead><tr><th>h<tbody><tr><td><table><tr><td>in</table><td>x</table>", "tbody > tr > td") == ["in", "x"]
    assert text("<p>a<ul><li>b<p>c<li>d</ul>e", "p") == ["a", "c"]
    assert text("<li><div><li>x</div>", "li li") == []
