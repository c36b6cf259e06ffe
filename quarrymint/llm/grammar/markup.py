"""TOML 1.0 and XML 1.0: lexers, grammars, and the rules that no context-free grammar says, each a function of its own."""

from __future__ import annotations

import re
from datetime import date

# --- TOML 1.0 --------------------------------------------------------------------------------------------------------

TOML = """
file = line (NL line)* EOF ;
line = (pair | '[' key ']' | OPEN key CLOSE)? ;
pair = key '=' value ;
key = part ('.' part)* ;
part = BARE | STRING ;
value = STRING | MULTI | SCALAR | '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']' | '{' (pair (',' pair)*)? '}' ;
"""
_U = r"u(?![dD][89abAB])[0-9a-fA-F]{4}|U(?:0000(?![dD][89abAB])|000[1-9a-fA-F]|0010)[0-9a-fA-F]{4}"
_TOML_STRING = rf'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|{_U}))*"' + r"|'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_TOML_MULTI = rf'"""(?:[^\\"\x00-\x08\x0b-\x1f\x7f]|\\(?:[btnfr"\\]|{_U}|[ \t]*\n[ \t\n]*)|"{{1,2}}(?!"))*"{{3,5}}' + r"|'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|'{1,2}(?!'))*'{3,5}"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_TOML_DATE = rf"\d{{4}}-\d\d-\d\d(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}"
_TOML_NUMBER = r"0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
_TOML_SPACE = re.compile(r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*(?=\n|\Z))?")
_TOML_KEY = re.compile(rf"(?P<NL>\n)|(?P<STRING>{_TOML_STRING})|(?P<BARE>[A-Za-z0-9_-]+)|(?P<OP>[]\[.={{}},])")
_TOML_VALUE = re.compile(rf"(?P<NL>\n)|(?P<MULTI>{_TOML_MULTI})|(?P<STRING>{_TOML_STRING})|(?P<SCALAR>(?:true|false|{_TOML_DATE}|{_TOML_NUMBER})(?![A-Za-z0-9_.:+-]))|(?P<OP>[]\[{{}},])", re.ASCII)
_DAY = re.compile(r"(\d{4})-(\d\d)-(\d\d)", re.ASCII)


def lex_toml(text: str, kinds: dict[str, int]):
    """Kinds, and (kind, text) of each token for the rules."""
    text = text.replace("\r\n", "\n")
    out, info, at, nest, value, fresh = [], [], 0, [], False, True
    n = len(text)

    def put(kind: str, s: str) -> None:
        out.append(kinds[kind])
        info.append((kind, s))

    while True:
        at = _TOML_SPACE.match(text, at).end()
        if at >= n:
            break
        if fresh and not nest and text.startswith("[[", at):
            put("OPEN", "[[")
            at, fresh = at + 2, False
            continue
        if not value and not nest and text.startswith("]]", at):
            put("CLOSE", "]]")
            at += 2
            continue
        m = (_TOML_VALUE if value else _TOML_KEY).match(text, at)
        if not m:
            return None
        at, kind = m.end(), m.lastgroup
        if kind == "OP":
            op = m.group()
            put(op, op)
            if op == "=":
                value = True
            elif value and op in "[{":
                nest.append(op)
                value = op == "["
            elif op in "]}" and nest:
                nest.pop()
                value = True
            elif op == "," and nest:
                value = nest[-1] == "["
        else:
            put(kind, m.group())
            if kind == "NL" and not nest:
                value = False
        fresh = kind == "NL"
    put("EOF", "")
    return out, info


def _plain(kind: str, s: str) -> str:
    """What a key part names."""
    if kind == "BARE" or s[0] == "'":
        return s.strip("'")
    simple = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}
    return re.sub(r"\\(?:u(.{4})|U(.{8})|(.))", lambda m: simple[m.group(3)] if m.group(3) else chr(int(m.group(1) or m.group(2), 16)), s[1:-1])


class _Table:
    """made: ``implied`` by a longer header, ``header``, or the number of the section whose dotted keys made it."""

    def __init__(self, made):
        self.made, self.items = made, {}


def toml_days_exist(info: list) -> bool:
    for kind, s in info:
        if kind == "SCALAR" and (m := _DAY.match(s)):
            try:
                date(*map(int, m.groups()))
            except ValueError:
                return False
    return True


def toml_keys_are_new(info: list) -> bool:
    """No key, table or header is given twice, and nothing is added to what is closed. A list of tables is a Python list,
    any other value None."""
    at, section = 0, 0
    root = current = _Table("header")

    def key() -> list[str]:
        nonlocal at
        parts = [_plain(*info[at])]
        at += 1
        while info[at][0] == ".":
            parts.append(_plain(*info[at + 1]))
            at += 2
        return parts

    def inner(table: _Table, parts: list[str], made) -> _Table | None:
        """The table that a header's or dotted key's first parts lead to."""
        for p in parts:
            if p not in table.items:
                table.items[p] = _Table(made)
            below = table.items[p]
            if isinstance(below, list) and made == "implied":
                below = below[-1]
            if not isinstance(below, _Table):
                return None
            if made != "implied":
                if below.made == "implied":
                    below.made = made
                elif below.made != made:
                    return None
            table = below
        return table

    def pair(table: _Table, made) -> bool:
        nonlocal at
        parts = key()
        at += 1
        home = inner(table, parts[:-1], made)
        if home is None or parts[-1] in home.items:
            return False
        home.items[parts[-1]] = None
        return value()

    def value() -> bool:
        nonlocal at
        todo, kept = [], None
        while True:  # a value, then what follows it in the arrays and inline tables around it
            kind = info[at][0]
            at += 1
            if kind == "{":
                todo.append(_Table("header"))
                kept = todo[-1]
            elif kind == "[":
                todo.append(None)
                kept = None
            else:
                kept = ()
            while True:
                while info[at][0] == "NL" and todo:
                    at += 1
                if not todo:
                    return True
                kind = info[at][0]
                if kind == "," and kept == ():
                    at += 1
                    while info[at][0] == "NL":
                        at += 1
                    kind = info[at][0]
                if kind in ("]", "}"):
                    at += 1
                    todo.pop()
                    kept = ()
                    continue
                break
            table = todo[-1]
            if isinstance(table, _Table):
                parts = key()
                at += 1
                home = inner(table, parts[:-1], 0)
                if home is None or parts[-1] in home.items:
                    return False
                home.items[parts[-1]] = None

    while info[at][0] != "EOF":
        kind = info[at][0]
        if kind == "NL":
            at += 1
        elif kind in ("[", "OPEN"):
            section += 1
            at += 1
            parts = key()
            at += 1
            home = inner(root, parts[:-1], "implied")
            if home is None:
                return False
            found = home.items.get(parts[-1], 0)
            current = _Table("header")
            if kind == "OPEN":
                if found == 0:
                    home.items[parts[-1]] = [current]
                elif isinstance(found, list):
                    found.append(current)
                else:
                    return False
            elif found == 0:
                home.items[parts[-1]] = current
            elif isinstance(found, _Table) and found.made == "implied":
                found.made, current = "header", found
            else:
                return False
        elif not pair(current, section):
            return False
    return True


# --- XML 1.0 ---------------------------------------------------------------------------------------------------------

XML = """
file = DECL? misc* (DOCTYPE misc*)? element misc* EOF ;
misc = COMMENT | PI | SPACE ;
element = OPEN attribute* ('/>' | '>' content* CLOSE) ;
attribute = NAME '=' QUOTED ;
content = element | TEXT | SPACE | REFERENCE | CDATA | COMMENT | PI ;
"""
_S = r"[ \t\r\n]"
_XS = r":A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
_XN = rf"[{_XS}][-.0-9\u00B7\u0300-\u036F\u203F\u2040{_XS}]*"
_XREF = rf"&(?:{_XN}|#[0-9]+|#x[0-9a-fA-F]+);"
_XQ = r"(?:\"[^\"]*\"|'[^']*')"
_NO = r"\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff"
_EXT = rf"(?:SYSTEM{_S}+{_XQ}|PUBLIC{_S}+(?:\"[-'()+,./:=?;!*#@$_%a-zA-Z0-9 \r\n]*\"|'[-()+,./:=?;!*#@$_%a-zA-Z0-9 \r\n]*'){_S}+{_XQ})"
_XPI = rf"<\?(?![xX][mM][lL](?:{_S}|\?)){_XN}(?:{_S}(?:(?!\?>)[^{_NO}])*)?\?>"
_XCOM = rf"<!--(?:[^-{_NO}]|-[^-{_NO}])*-->"
_XENT = rf"<!ENTITY{_S}+(?:%{_S}+)?{_XN}{_S}+(?:\"(?:[^%&\"]|{_XREF}|%{_XN};)*\"|'(?:[^%&']|{_XREF}|%{_XN};)*'|{_EXT}(?:{_S}+NDATA{_S}+{_XN})?){_S}*>"
_TYPE = rf"(?:CDATA|ID|IDREF|IDREFS|ENTITY|ENTITIES|NMTOKEN|NMTOKENS|(?:NOTATION{_S}+)?\({_S}*[-.:\w]+(?:{_S}*\|{_S}*[-.:\w]+)*{_S}*\))"
_XATT = rf"<!ATTLIST{_S}+{_XN}(?:{_S}+{_XN}{_S}+{_TYPE}{_S}+(?:#REQUIRED|#IMPLIED|(?:#FIXED{_S}+)?(?:\"(?:[^<&\"]|{_XREF})*\"|'(?:[^<&']|{_XREF})*')))*{_S}*>"
_XELE = rf"<!ELEMENT{_S}+{_XN}{_S}+(?:EMPTY|ANY|\([^<>\"'&;]*\)[?*+]?){_S}*>"
_XNOT = rf"<!NOTATION{_S}+{_XN}{_S}+(?:{_EXT}|PUBLIC{_S}+{_XQ}){_S}*>"
_SUBSET = rf"(?:{_S}|%{_XN};|{_XELE}|{_XATT}|{_XENT}|{_XNOT}|{_XPI}|{_XCOM})*"
_XML_CONTENT = re.compile(
    rf"(?P<DECL>\A<\?xml{_S}+version{_S}*={_S}*(?:'1\.[0-9]+'|\"1\.[0-9]+\")(?:{_S}+encoding{_S}*={_S}*(?:'[A-Za-z][-A-Za-z0-9._]*'|\"[A-Za-z][-A-Za-z0-9._]*\"))?(?:{_S}+standalone{_S}*={_S}*(?:'(?:yes|no)'|\"(?:yes|no)\"))?{_S}*\?>)"
    rf"|(?P<COMMENT>{_XCOM})|(?P<CDATA><!\[CDATA\[(?:(?!\]\]>)[^{_NO}])*\]\]>)|(?P<DOCTYPE><!DOCTYPE{_S}+{_XN}(?:{_S}+{_EXT})?{_S}*(?:\[{_SUBSET}\]{_S}*)?>)"
    rf"|(?P<PI>{_XPI})|(?P<CLOSE></{_XN}{_S}*>)|(?P<OPEN><{_XN})|(?P<REFERENCE>{_XREF})|(?P<SPACE>{_S}+(?=<|\Z))|(?P<TEXT>(?:(?!\]\]>)[^<&{_NO}])+)"
)
_XML_TAG = re.compile(rf"{_S}*(?:(?P<GT>/?>)|(?P<EQ>=)|(?P<QUOTED>\"(?:[^<&\"{_NO}]|{_XREF})*\"|'(?:[^<&'{_NO}]|{_XREF})*')|(?P<NAME>{_XN}))")
_REF = re.compile(_XREF)


def lex_xml(text: str, kinds: dict[str, int]):
    """Kinds, and (kind, text) of each token for the rules."""
    text = text.removeprefix("\ufeff")
    out, info, at, tag = [], [], 0, False
    while at < len(text):
        m = (_XML_TAG if tag else _XML_CONTENT).match(text, at)
        if not m or m.end() == at:
            return None
        kind = m.lastgroup
        if tag and kind == "NAME" and text[at] not in " \t\r\n":
            return None
        at = m.end()
        info.append((kind, m.group()))
        if kind == "GT":
            tag = False
            kind = m.group("GT")
        elif kind == "EQ":
            kind = "="
        elif kind == "OPEN":
            tag = True
        out.append(kinds[kind])
    return None if tag else ([*out, kinds["EOF"]], info)


def xml_tags_match(info: list) -> bool:
    open_ = []
    for kind, s in info:
        if kind == "OPEN":
            open_.append(s[1:])
        elif kind == "GT" and s.lstrip() == "/>":
            open_.pop()
        elif kind == "CLOSE" and open_.pop() != s[2:-1].rstrip(" \t\r\n"):
            return False
    return True


def xml_attributes_are_new(info: list) -> bool:
    seen: set = set()
    for kind, s in info:
        if kind == "OPEN":
            seen = set()
        elif kind == "NAME":
            name = s.strip(" \t\r\n")
            if name in seen:
                return False
            seen.add(name)
    return True


_MIXED = re.compile(rf"\({_S}*#PCDATA(?:{_S}*\|{_S}*{_XN})*{_S}*\)\*|\({_S}*#PCDATA{_S}*\)")
_INNER = re.compile(rf"\({_S}*(?:{_XN}|~)[?*+]?(?:(?:{_S}*,{_S}*(?:{_XN}|~)[?*+]?)*|(?:{_S}*\|{_S}*(?:{_XN}|~)[?*+]?)*){_S}*\)")


def xml_models_are_right(info: list) -> bool:
    """The content of declared elements: text with names, or groups of names, taken off from the inside."""
    doctype = next((s for kind, s in info if kind == "DOCTYPE"), "")
    for model in re.findall(rf"<!ELEMENT{_S}+{_XN}{_S}+(\([^>]*?){_S}*>", doctype):
        if _MIXED.fullmatch(model):
            continue
        n = 1
        while n:
            model, n = _INNER.subn("~", model)
        if not re.fullmatch(r"~[?*+]?", model):
            return False
    return True


def xml_references_are_known(info: list) -> bool:
    """Character references are characters; entities are predefined or declared, or may be so in a file outside."""
    doctype = next((s for kind, s in info if kind == "DOCTYPE"), "")
    decl = next((s for kind, s in info if kind == "DECL"), "")
    known = {"lt", "gt", "amp", "apos", "quot", *re.findall(rf"<!ENTITY{_S}+({_XN})", doctype)}
    outside = re.match(rf"<!DOCTYPE{_S}+{_XN}{_S}+(?:SYSTEM|PUBLIC)", doctype) or re.search(rf"%{_XN};", doctype)
    lenient = bool(outside) and not re.search(r"standalone\s*=\s*.yes", decl)
    for kind, s in info:
        for ref in _REF.findall(s) if kind in ("REFERENCE", "QUOTED") else ():
            body = ref[1:-1]
            if body[0] == "#":
                n = int(body[2:], 16) if body[1] == "x" else int(body[1:])
                if not (n in (9, 10, 13) or 0x20 <= n <= 0xD7FF or 0xE000 <= n <= 0xFFFD or 0x10000 <= n <= 0x10FFFF):
                    return False
            elif body not in known and not lenient:
                return False
    return True
