"""Office formulas (OMML) as presentation MathML and as linear text."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, functions as F

_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
MATHML = "http://www.w3.org/1998/Math/MathML"
_NARY = "∫"
Pair = tuple[str, str]


def _val(node: ET.Element | None, path: str, default: str = "") -> str:
    found = node.find("/".join(f"{_M}{p}" for p in path.split("/"))) if node is not None else None
    return default if found is None else found.get(f"{_M}val", found.get("val", "on"))


def _on(value: str) -> bool:
    return value not in ("", "0", "off", "false")


def _tag(name: str, *inner: str, **attrs: str) -> str:
    extra = "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in attrs.items())
    return f"<{name}{extra}>{''.join(inner)}</{name}>"


def _row(pairs: list[Pair]) -> Pair:
    if len(pairs) == 1:
        return pairs[0]
    return _tag("mrow", *[x for x, _ in pairs]), "".join(t for _, t in pairs)


def _grouped(text: str) -> str:
    return text if len(text) <= 1 else f"({text})"


class Formula:
    """One formula; unsupported element names are kept aside and their contents converted."""

    def __init__(self) -> None:
        self.unsupported: list[str] = []

    def children(self, node: ET.Element | None) -> Pair:
        return _row([self.one(c) for c in (node if node is not None else ()) if not c.tag.endswith("Pr")])

    def arg(self, node: ET.Element, name: str = "e") -> Pair:
        return self.children(node.find(f"{_M}{name}"))

    def one(self, node: ET.Element) -> Pair:
        name = node.tag.removeprefix(_M)
        rule: Callable[[ET.Element], Pair] | None = getattr(self, f"do_{name}", None) if node.tag.startswith(_M) else None
        if rule is None:
            if node.tag.startswith(_M) and name not in ("oMath", "oMathPara", "e", "num", "den", "sub", "sup", "deg", "fName", "lim") and name not in self.unsupported:
                self.unsupported.append(name)
            return self.children(node)
        return rule(node)

    def do_r(self, node: ET.Element) -> Pair:
        text = "".join(t.text or "" for t in node.iter(f"{_M}t"))
        plain = _val(node, "rPr/sty") == "p" or node.find(f"{_M}rPr/{_M}nor") is not None
        if plain and not text.strip("0123456789."):
            plain = False
        if plain:
            return _tag("mtext", escape(text)), text
        parts, at = [], 0
        while at < len(text):
            end = at + 1
            if text[at].isdigit():
                while end < len(text) and (text[end].isdigit() or text[end] == "." and text[end + 1 : end + 2].isdigit()):
                    end += 1
            kind = "mn" if text[at].isdigit() else "mi" if text[at].isalpha() else "mo"
            if not text[at:end].isspace():
                parts.append(_tag(kind, escape(text[at:end])))
            at = end
        return (parts[0] if len(parts) == 1 else _tag("mrow", *parts)), text

    def do_f(self, node: ET.Element) -> Pair:
        (a, s), (b, t) = self.arg(node, "num"), self.arg(node, "den")
        kind = _val(node, "fPr/type")
        if kind == "lin":
            return _tag("mrow", a, "<mo>/</mo>", b), f"{s}/{t}"
        attrs = {"noBar": {"linethickness": "0"}, "skw": {"bevelled": "true"}}.get(kind, {})
        return _tag("mfrac", a, b, **attrs), f"{_grouped(s)}/{_grouped(t)}"

    def do_sSup(self, node: ET.Element) -> Pair:
        (a, s), (b, t) = self.arg(node), self.arg(node, "sup")
        return _tag("msup", a, b), f"{_grouped(s)}^{_grouped(t)}"

    def do_sSub(self, node: ET.Element) -> Pair:
        (a, s), (b, t) = self.arg(node), self.arg(node, "sub")
        return _tag("msub", a, b), f"{_grouped(s)}_{_grouped(t)}"

    def do_sSubSup(self, node: ET.Element) -> Pair:
        (a, s), (b, t), (c, u) = self.arg(node), self.arg(node, "sub"), self.arg(node, "sup")
        return _tag("msubsup", a, b, c), f"{_grouped(s)}_{_grouped(t)}^{_grouped(u)}"

    def do_sPre(self, node: ET.Element) -> Pair:
        (a, s), (b, t), (c, u) = self.arg(node), self.arg(node, "sub"), self.arg(node, "sup")
        return _tag("mmultiscripts", a, "<mprescripts/>", b, c), f"_{_grouped(t)}^{_grouped(u)}{s}"

    def do_rad(self, node: ET.Element) -> Pair:
        (a, s), (b, t) = self.arg(node), self.arg(node, "deg")
        if _on(_val(node, "radPr/degHide")) or not t:
            return _tag("msqrt", a), f"√({s})"
        return _tag("mroot", a, b), f"root({t},{s})"

    def do_nary(self, node: ET.Element) -> Pair:
        sign = _val(node, "naryPr/chr", _NARY)
        (a, s), (b, t), (c, u) = self.arg(node), self.arg(node, "sub"), self.arg(node, "sup")
        under = _val(node, "naryPr/limLoc", "subSup" if sign == _NARY else "undOvr") == "undOvr"
        show = [x for x, hide, text in ((b, "subHide", t), (c, "supHide", u)) if text and not _on(_val(node, f"naryPr/{hide}"))]
        op = _tag("mo", escape(sign))
        names = {2: ("msubsup", "munderover"), 1: ("msub", "munder") if t and b in show else ("msup", "mover"), 0: None}[len(show)]
        head = op if names is None else _tag(names[under], op, *show)
        return _tag("mrow", head, a), f"{sign}{f'_{_grouped(t)}' if b in show and t else ''}{f'^{_grouped(u)}' if c in show and u else ''} {s}"

    def do_d(self, node: ET.Element) -> Pair:
        begin, end, mid = _val(node, "dPr/begChr", "("), _val(node, "dPr/endChr", ")"), _val(node, "dPr/sepChr", "|")
        begin, end = ("" if x == "on" else x for x in (begin, end))
        parts = [self.children(e) for e in node.findall(f"{_M}e")]
        between = _tag("mo", escape(mid))
        return _tag("mrow", _tag("mo", escape(begin)), between.join(x for x, _ in parts), _tag("mo", escape(end))), begin + mid.join(t for _, t in parts) + end

    def do_func(self, node: ET.Element) -> Pair:
        (a, s), (b, t) = self.arg(node, "fName"), self.arg(node)
        return _tag("mrow", a, "<mo>⁡</mo>", b), f"{s}({t})" if not t.startswith("(") else s + t

    def _limit(self, node: ET.Element, name: str, mark: str) -> Pair:
        (a, s), (b, t) = self.arg(node), self.arg(node, "lim")
        return _tag(name, a, b), f"{s}{mark}{_grouped(t)}"

    def do_limLow(self, node: ET.Element) -> Pair:
        return self._limit(node, "munder", "_")

    def do_limUpp(self, node: ET.Element) -> Pair:
        return self._limit(node, "mover", "^")

    def do_acc(self, node: ET.Element) -> Pair:
        a, s = self.arg(node)
        mark = _val(node, "accPr/chr", "̂")
        return _tag("mover", a, _tag("mo", escape(mark)), accent="true"), s + mark

    def do_bar(self, node: ET.Element) -> Pair:
        a, s = self.arg(node)
        top = _val(node, "barPr/pos", "bot") == "top"
        return _tag("mover" if top else "munder", a, "<mo>¯</mo>" if top else "<mo>_</mo>"), s

    def do_groupChr(self, node: ET.Element) -> Pair:
        a, s = self.arg(node)
        top = _val(node, "groupChrPr/pos", "bot") == "top"
        return _tag("mover" if top else "munder", a, _tag("mo", escape(_val(node, "groupChrPr/chr", "⏟")))), s

    def do_m(self, node: ET.Element) -> Pair:
        rows = [[self.children(e) for e in r.findall(f"{_M}e")] for r in node.findall(f"{_M}mr")]
        return _tag("mtable", *[_tag("mtr", *[_tag("mtd", x) for x, _ in r]) for r in rows]), "[" + ";".join(",".join(t for _, t in r) for r in rows) + "]"

    def do_eqArr(self, node: ET.Element) -> Pair:
        rows = [self.children(e) for e in node.findall(f"{_M}e")]
        return _tag("mtable", *[_tag("mtr", _tag("mtd", x)) for x, _ in rows]), ";".join(t for _, t in rows)

    def do_box(self, node: ET.Element) -> Pair:
        return self.arg(node)

    def do_borderBox(self, node: ET.Element) -> Pair:
        a, s = self.arg(node)
        return _tag("menclose", a, notation="box"), s

    def do_phant(self, node: ET.Element) -> Pair:
        a, s = self.arg(node)
        return (a, s) if _on(_val(node, "phantPr/show", "on")) and node.find(f"{_M}phantPr/{_M}show") is not None else (_tag("mphantom", a), "")


def converted(omml: str | None) -> tuple[str | None, str | None, list[str], str | None]:
    """MathML, linear text, unsupported element names and error of one formula."""
    try:
        if "<!DOCTYPE" in (omml or ""):
            raise ValueError("document types are not read")
        formula = Formula()
        inner, text = formula.one(ET.fromstring(omml or ""))
        return f'<math xmlns="{MATHML}">{inner}</math>', text, formula.unsupported, None
    except (ET.ParseError, ValueError, RecursionError) as broken:
        return None, None, [], str(broken)


def _frame(formulas: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([converted(x) for x in formulas], columns=["mathml", "text", "unsupported", "error"])


def omml_to_mathml(c: Column) -> Column:
    """struct<mathml, text, unsupported, error> of a column of OMML."""
    return F.pandas_udf(_frame, "mathml string, text string, unsupported array<string>, error string")(c)
