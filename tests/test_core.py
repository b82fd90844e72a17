import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.core import brackets, entities, markup
from tests import vectors as v


def tree(nodes):
    kids = {-1: []}
    for i, n in enumerate(nodes):
        kids[i] = []
        kids[n.parent].append((n.kind, n.name, n.value, kids[i]))
    return kids[-1]


@pytest.mark.parametrize("text,offsets", v.UNMATCHED.items())
def test_unmatched(text, offsets):
    assert brackets.unmatched(text.encode()) == offsets


@pytest.mark.parametrize("text,want", v.PARSE)
def test_parse(text, want):
    nodes = markup.parse(text.encode())
    assert tree(nodes) == want
    assert nodes == markup.rebuild(want)


@pytest.mark.parametrize("text", v.FAILS)
def test_parse_fails(text):
    with pytest.raises(markup.MarkupError):
        markup.parse(text.encode())


@pytest.mark.parametrize("text,message,offset", [("a(b", "unmatched opener (", 3), ("b)c", "expected end of file", 1), ("a(]b", "opener ( closed with mismatched ]", 2), ("p{a}[]", "attribute value expected", 3), ("p{}", "expecting opener [", 3), ("p{a=[x]y}[]", "end of attribute value expected", 7), ("p{1=x}[]", "invalid attribute name", 3), ("p{a[]}[]", "attribute name expected", 3)])
def test_error_place(text, message, offset):
    with pytest.raises(markup.MarkupError) as e:
        markup.parse(text.encode())
    assert (e.value.message, e.value.offset) == (message, offset)
    assert str(e.value) == f"1:{offset + 1} {message}"


@pytest.mark.parametrize("text,want", v.TRANSFORMED)
def test_transforms(text, want):
    nodes = markup.direct_quotes(markup.decode_entities(markup.parse(text.encode())))
    assert tree(nodes) == want and nodes == markup.rebuild(want)


@pytest.mark.parametrize("given_,want", v.ESCAPED)
def test_escape_brackets(given_, want):
    nodes = markup.escape_brackets(markup.rebuild(given_))
    assert tree(nodes) == want and nodes == markup.rebuild(want)


@pytest.mark.parametrize("forest,want", v.MARKUP)
def test_write_markup(forest, want):
    assert markup.write_markup(markup.rebuild(forest)) == want


@pytest.mark.parametrize("forest,want", v.HTML)
def test_write_html(forest, want):
    assert markup.write_tags(markup.rebuild(forest)) == want


@pytest.mark.parametrize("forest,want", v.XML)
def test_write_xml(forest, want):
    assert markup.write_tags(markup.rebuild(forest), xml=True) == want


def test_entity_tables():
    assert len(entities.HTML) == 2125 and len(entities.SYMBOLIC) == 92
    assert not set(entities.HTML) & set(entities.SYMBOLIC)
    assert entities.SYMBOLIC["<-->"] == "↔" and entities.HTML["fjlig"] == "fj"


def by_recursion(data):
    """The rule as a recursion: an opener scans its content up to a closer no inner pair takes."""
    lost = []

    def content(at, outer):
        while at < len(data):
            b = data[at]
            if b in brackets.PAIRS:
                end = content(at + 1, False)
                if end < len(data) and data[end] == brackets.PAIRS[b]:
                    at = end + 1
                    continue
                lost.append(at)
                at = end
            elif b in b")]}":
                if not outer:
                    return at
                lost.append(at)
                at += 1
            else:
                at += 1
        return at

    content(0, True)
    return sorted(lost)


@settings(max_examples=500, deadline=None)
@given(st.text("()[]{}a", max_size=14))
def test_stack_rule_is_the_recursion(text):
    assert brackets.unmatched(text.encode()) == by_recursion(text.encode())


@settings(max_examples=300, deadline=None)
@given(st.text("()[]{}ab é", max_size=20))
def test_escaping_balances(text):
    nodes = markup.escape_brackets(markup.rebuild([("text", None, text, [])]))
    assert not brackets.unmatched("".join(n.value for n in nodes if n.kind == "text").encode())


@settings(max_examples=300, deadline=None)
@given(st.text("ab c()[]{}é", max_size=20))
def test_round_trip_of_escaped_text(text):
    nodes = markup.escape_brackets(markup.rebuild([("text", None, text, [])]), entities.SYMBOLIC_ESCAPES)
    merged = lambda ns: "".join(n.value if n.kind == "text" else entities.SYMBOLIC[n.name] for n in ns)
    try:
        again = markup.parse(markup.write_markup(nodes).encode())
    except markup.MarkupError:
        pytest.fail("written markup does not parse")
    if not any(n.kind == "ref" for n in nodes):
        assert merged(again) == text


def test_deep_nesting_and_long_text():
    deep = "(" * 50_000 + ")" * 50_000
    assert brackets.unmatched(deep.encode()) == [] and markup.parse(deep.encode())[0].value == deep
    nested = "a[" * 5_000 + "]" * 5_000
    assert markup.write_markup(markup.parse(nested.encode())) == nested
