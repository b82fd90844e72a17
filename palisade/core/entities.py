"""Names of characters: the HTML table, and symbolic names made of punctuation."""

from __future__ import annotations

from html.entities import html5

#: The standard HTML names, without the semicolon.
HTML: dict[str, str] = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}

_FRACTIONS = {"1/4": 0xBC, "1/2": 0xBD, "3/4": 0xBE, "1/7": 0x2150, "1/9": 0x2151, "1/10": 0x2152, "1/3": 0x2153, "2/3": 0x2154, "1/5": 0x2155, "2/5": 0x2156, "3/5": 0x2157, "4/5": 0x2158, "1/6": 0x2159, "5/6": 0x215A, "1/8": 0x215B, "3/8": 0x215C, "5/8": 0x215D, "7/8": 0x215E}
# Name and code point alternate; grouped by what the signs depict.
_SIGNS = """
-- 2013 --- 2014
+- B1 -+ 2213 x D7 d F7 . 22C5 : 2236 :: 2237 2rt 221A 3rt 221B 4rt 221C
<= 2264 >= 2265 <> 2276 >< 2277 << 226A >> 226B <<< 22D8 >>> 22D9 ~~ 2248 ~~= 224A def= 225D
/= 2260 /< 226E /> 226F /<= 2270 />= 2271 /<> 2278 />< 2279 /~~ 2249
<-- 2190 --> 2192 <-> 2194 <== 21D0 ==> 21D2 <=> 21D4
<--- 27F5 ---> 27F6 <--> 2194 <=== 27F8 ===> 27F9 <==> 27FA
/<-- 219A /--> 219B /<-> 21AE /<== 21CD /==> 21CF /<=> 21CE
|-- 22A2 --| 22A3 ~|~ 22A4 _|_ 22A5 |- 22A6 |= 22A7 |== 22A8 ||- 22A9 ||= 22AB
/|-- 22AC /|== 22AD /||- 22AE /||= 22AF
-. AC ^ 2227 v 2228 v- 22BB -^ 22BC -v 22BD
""".split()

#: Names that are readable as the sign they stand for.
SYMBOLIC: dict[str, str] = (
    {f"{o}{way}{c}": (o if way == "<" else c) for o, c in ("()", "[]", "{}") for way in "<>"}
    | {name: chr(int(code, 16)) for name, code in zip(_SIGNS[::2], _SIGNS[1::2])}
    | {name: chr(code) for name, code in _FRACTIONS.items()}
)

ALL: dict[str, str] = SYMBOLIC | HTML

#: Elements HTML writes without an end tag when they are empty.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

DECIMAL_ESCAPES = {b: f"#{ord(b)}" for b in "()[]{}"}
SYMBOLIC_ESCAPES = {text: name for name, text in SYMBOLIC.items() if text in "()[]{}"}
