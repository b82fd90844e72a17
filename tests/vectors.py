"""Test tables: inputs and what they must give, as nested (kind, ...) tuples."""


def t(s):
    return ("text", None, s, [])


def raw(s):
    return ("rawtext", None, s, [])


def ref(n):
    return ("ref", n, None, [])


def com(s):
    return ("comment", None, s, [])


def attr(n, *kids):
    return ("attr", n, None, list(kids))


def el(n, *kids):
    return ("element", n, None, list(kids))


UNMATCHED = {
    "": [], "()[]{}": [], "([{}])": [], "k(l[m{n}o]p)q": [], "([{([{}])}])": [],
    "(": [0], "[": [0], "{": [0], ")": [0], "]": [0], "}": [0],
    "[{})": [0, 3], "a[b{c}d)e": [1, 7], ")}]({[": [0, 1, 2, 3, 4, 5],
    "[{}({}[())])": [6, 11], "([{)}}]])": [1, 2, 4, 5, 6, 7, 8],
}

FAILS = """a(b|b)c|a[b|a]b|a{b|a}b|a(]b|a{)b|p{|p{}|p{}[|p{a}[]|p{> }|p{ <}|p{a}> []|p{a} <[]|p{ a= <[]}[]|p{ a=[]> }[]|p{a=[x]y}[]|p{a=x b}[]|p{ a=x b }[]|+{x}|-{x}""".split("|")

# Literal input and the text it stands for.
LITERAL = [
    ("foo", "foo"), ("a(b)c", "a(b)c"), ("[]", "[]"), ("[ x ]", "[ x ]"), ("[xx ]", "[xx ]"), ("[ xx]", "[ xx]"),
    ("[> x]", "[x]"), ("[x <]", "[x]"), ("[> x <]", "[x]"), ("()[]{}", "()[]{}"), (" [ [ ] ] ", " [ [ ] ] "),
    ("a <(x y)", "a <(x y)"), ("a <[x y]", "a[x y]"), ("a <{x y}", "a{x y}"), ("> <(> <)> <", "> <(> <)> <"),
    ("> <{> <}> <", ">{}<"), ("> <[> <]> <", ">[]<"), ("> <(> x <)> <", "> <(> x <)> <"),
    ("> <{> x <}> <", ">{x}<"), ("> <[> x <]> <", ">[x]<"), ("([{x}])", "([{x}])"),
]

PARSE = [(s, [t(x)]) for s, x in LITERAL] + [("", []), ("+[]", []), ("-[]", [])]
PARSE += [(f"[{n}]", [ref(n)]) for n in ("deg", "#123", "#x12ab", "?", "#", "#a", "#x", "#x@", "#xg")]
PARSE += [
    (" [deg]", [t(" "), ref("deg")]), ("<[deg]", [t("<"), ref("deg")]), ("x <[deg]", [t("x"), ref("deg")]),
    ("[deg] ", [ref("deg"), t(" ")]), ("[deg]>", [ref("deg"), t(">")]), ("[deg]>x", [ref("deg"), t(">x")]),
    ("[deg]> x", [ref("deg"), t("x")]),
]
PARSE += [(s, [t(o), ref("deg"), t(c)]) for s, o, c in (
    ("([deg])", "(", ")"), ("[[deg]]", "[", "]"), ("{[deg]}", "{", "}"), ("(\t<[deg]>\n)", "(", ")"),
    ("[\r\n<[deg]>\n\r]", "[", "]"), ("{ \t\n<[deg]>\n\t }", "{", "}"))]
PARSE += [(s, [el(n)]) for s, n in (
    ("p[]", "p"), ("*[]", "*"), (" <p[]", "p"), (" <<[]", "<"), (" <>[]", ">"), (" <<<[]", "<<"), (" <<<>>[]", "<<>>"),
    ("p[]> ", "p"), ("x<p[]", "x<p"), ("p[> ]", "p"), ("p[ <]", "p"), ("p[> <]", "p"), (" <p[> <]> ", "p"),
    ("p[> \t\r\n <]", "p"), ("p{}[]", "p"))]
PARSE += [(s, [el("p", t(x))]) for s, x in (
    ("p[q]", "q"), ("p[x]", "x"), ("p[><]", "><"), ("p[> x]", "x"), ("p[> <x]", "<x"), ("p[x <]", "x"), ("p[x> <]", "x>"),
    ("p[>\t\n\r one \t\n\r<]", "one"), ("\r\t\n <p[> one <]> \r\t\n", "one"))]
PARSE += [
    ("*[+]", [el("*", t("+"))]), (" p[]", [t(" "), el("p")]), ("p[] ", [el("p"), t(" ")]), ("x <p[]", [t("x"), el("p")]),
    ("< <p[]", [t("<"), el("p")]), ("p[]>x", [el("p"), t(">x")]), ("p[]> x", [el("p"), t("x")]),
    ("x[y[]]", [el("x", el("y"))]), (" <ul[> <li[> <]> <]> ", [el("ul", el("li"))]), ("a+[x]", [el("a+", t("x"))]),
]
PARSE += [(f"p{{{a}}}[]", [el("p", attr("a"))]) for a in ("a=", " a= ", "a=[]", " a=[] ", "a= ")]
PARSE += [(f"p{{a={v}}}[]", [el("p", attr("a", t(x)))]) for v, x in (
    ("x", "x"), ("[x]", "x"), ("[> x <]", "x"), ("[ x ]", " x "), ("(x)", "(x)"), ("{x}", "{x}"), ("[x y]", "x y"),
    ("(x y)", "(x y)"), ("{x y}", "{x y}"), ("x ", "x"), ("[x <[> y <]> ]", "x[y]"))]
PARSE += [(s, [el("p", attr("a", t("x")), attr("b", t("y")))]) for s in ("p{a=x  b=y}[]", "p{ a=[x]  b=y }[]")]
PARSE += [
    (" <q{k=[>  <]}[> <]> ", [el("q", attr("k"))]), ("q{z=[[w]]}[]", [el("q", attr("z", ref("w")))]),
    ("p{cd=[uu[vv]]}[]", [el("p", attr("cd", t("uu"), ref("vv")))]), ("p{ a=x }[]", [el("p", attr("a", t("x")))]),
]
PARSE += [(f"+[{s}]", [raw(s)]) for s in ("x", "p[]", "p[x]", "[x]", "+[x]", "x[y]z", "() <[> <]> {}")]
PARSE += [(" <+[x]> ", [raw("x")]), ("a <+[x]> b", [t("a"), raw("x"), t("b")]), (" <-[x]> ", [com("x")])]
PARSE += [(f"-[{s}]", [com(s)]) for s in ("x", "> abc <", "> ({[]}) <")]

TRANSFORMED = [(f"[{o}<{c}]", [t(o)]) for o, c in ("()", "[]", "{}")] + [(f"[{o}>{c}]", [t(c)]) for o, c in ("()", "[]", "{}")]
TRANSFORMED += [
    ("[star][cir][larr]", [t("☆"), t("○"), t("←")]), ("[+-][--][==>]", [t("±"), t("–"), t("⇒")]),
    ("[[<]][(>)][{<}][[>]][(<)][{>}]", [t(x) for x in "[){](}"]), ("\n <[(<)]> \t <[::]> \r", [t("("), t("∷")]),
    ("'[quote]", [t("‘"), t("quote"), t("’")]), ('"[quote]', [t("“"), t("quote"), t("”")]),
    ("p{a=[[deg]]}['{b=c}[x \"[y]]]", [el("p", attr("a", ref("deg")), t("‘"), t("x "), t("“"), t("y"), t("”"), t("’"))]),
]

ESCAPED = [
    ([], []), ([t("abc")], [t("abc")]), ([t("k(l)m{n}o[p]q")], [t("k(l)m{n}o[p]q")]),
    ([t("k(l[m{n"), ref("bar"), t("o}p]q)r")], [t("k(l[m{n"), ref("bar"), t("o}p]q)r")]),
    ([t("k)l]m}n{o[p(q")], [t("k"), ref("#41"), t("l"), ref("#93"), t("m"), ref("#125"), t("n"), ref("#123"), t("o"), ref("#91"), t("p"), ref("#40"), t("q")]),
    ([t("k)l]m}n"), ref("bar"), t("o{p[q(r")], [t("k"), ref("#41"), t("l"), ref("#93"), t("m"), ref("#125"), t("n"), ref("bar"), t("o"), ref("#123"), t("p"), ref("#91"), t("q"), ref("#40"), t("r")]),
]

_PLAIN = ["abc", "x\"'\n\r\ty"]
_ELEMENTS = [
    ([el("em", t("emphasis"))], "em[emphasis]", "<em>emphasis</em>", "<em>emphasis</em>"),
    ([el("dl", el("dt", t("within")))], "dl[dt[within]]", "<dl><dt>within</dt></dl>", "<dl><dt>within</dt></dl>"),
    ([el("a", attr("href", t("home")), t("go"))], "a{href=[home]}[go]", '<a href="home">go</a>', '<a href="home">go</a>'),
    ([el("img", attr("id", t("one")), attr("alt", t("two")))], "img{id=[one] alt=[two]}[]", '<img id="one" alt="two"/>', '<img id="one" alt="two"/>'),
    ([el("w", attr("z", t("<\">'&")))], "w{z=[<\">'&]}[]", "<w z=\"&lt;&quot;&gt;'&amp;\"></w>", "<w z=\"&lt;&quot;&gt;'&amp;\"/>"),
    ([el("p")], "p[]", "<p></p>", "<p/>"), ([el("br")], "br[]", "<br/>", "<br/>"),
    ([el("hr", attr("width", t("100%")))], "hr{width=[100%]}[]", '<hr width="100%"/>', '<hr width="100%"/>'),
    ([el("p", attr("a", ref("deg"), t("x")), el("br"), com("a--b-"))], "p{a=[[deg]x]}[br[] <-[a--b-]]", None, None),
]
MARKUP = [([], "")] + [([t(x)], x) for x in _PLAIN] + [([t("abc"), t("xyz")], "abcxyz")] + [([t(x)], x) for x in ("()", "[]", "{}", "(a)", "(x y)", "[x y]", "{a}", "{x y}")]
MARKUP += [([raw(x)], f"+[{x}]") for x in ("abc", "[foo]", "mark[up]", "+[nested]", "+[twice +[inside]]")]
MARKUP += [([ref(x)], f"[{x}]") for x in ("hello", "#123", "#xabcd")] + [(n, m) for n, m, _, _ in _ELEMENTS[:-1]]
MARKUP += [([t(a)], b) for a, b in (
    ("[x]", "[x <]"), ("[x][y]", "[x <][y <]"), ("a[]", "a <[]"), ("a[x y]", "a <[x y]"), ("a[b]c", "a <[b <]c"),
    ("a[b]c[d]", "a <[b <]c <[d <]"), ("a{}", "a <{}"), ("a{x y}", "a <{x y}"), ("a{b}c", "a <{b}c"), ("a{b}c{d}", "a <{b}c <{d}"))]
HTML = [([], "")] + [([t(x)], x) for x in _PLAIN] + [([t("abc"), t("xyz")], "abcxyz"), ([t("k&l<m>n\"o'p")], "k&amp;l&lt;m&gt;n\"o'p")]
HTML += [([raw("abc")], "abc"), ([raw("&foo;")], "&amp;foo;"), ([raw("<b></i>")], "&lt;b&gt;&lt;/i&gt;"), ([raw("]]>")], "]]&gt;")]
HTML += [([ref(x)], f"&{x};") for x in ("hello", "#123", "#xabcd")] + [(n, h) for n, _, h, _ in _ELEMENTS[:-1]]
HTML += [([el("p", attr("a", ref("deg"), t("x")), el("br"), com("a--b-"))], '<p a="&deg;x"><br/><!--a-&#45;b---></p>')]
XML = [([], "")] + [([t(x)], x) for x in _PLAIN] + [([t("abc"), t("xyz")], "abcxyz"), ([t("k&l<m>n\"o'p")], "k&amp;l&lt;m&gt;n\"o'p")]
XML += [([raw(x)], f"<![CDATA[{x}]]>") for x in ("abc", "&foo;", "<b></i>")]
XML += [([raw("u]]>v")], "<![CDATA[u]]]]><![CDATA[>v]]>"), ([raw("some <![CDATA[inner]]> part")], "<![CDATA[some <![CDATA[inner]]]]><![CDATA[> part]]>")]
XML += [([ref(x)], f"&{x};") for x in ("hello", "#123", "#xabcd")] + [(n, x) for n, _, _, x in _ELEMENTS[:-1]]
