"""The supported languages: lexers, grammars, dialects, and the rules beside the grammar. A lexer gives token kinds, or None
where a character fits no token."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from quarrymint.llm.grammar import ecmascript, markup
from quarrymint.llm.grammar.early import EarlyErrors
from quarrymint.llm.grammar.gll import Grammar
from quarrymint.llm.grammar.python import PYTHON, lex_python

# --- JSON ------------------------------------------------------------------------------------------------------------

JSON = """
file = value EOF ;
value = STRING | NUMBER | WORD | '[' (value (',' value)*)? ']' | '{' (STRING ':' value (',' STRING ':' value)*)? '}' ;
"""
_JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([][{},:])|($))')


def lex_json(text: str, kinds: dict[str, int]):
    out, at = [], 0
    text = text.rstrip(" \t\r\n")
    while at < len(text):
        m = _JSON_TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        out.append(kinds[m.group(4)] if m.group(4) else kinds[("STRING", "NUMBER", "WORD")[m.lastindex - 1]])
    return [*out, kinds["EOF"]], None


# --- all of them -----------------------------------------------------------------------------------------------------


@dataclass
class Language:
    """``rules`` see what the lexer gives beside the kinds; each must hold."""

    lexer: Callable
    grammar: Grammar
    starts: tuple[str, ...] = ("file",)
    rules: tuple[Callable, ...] = ()


@lru_cache(maxsize=1)
def languages() -> dict[str, Language]:
    """The languages by extension."""
    late: dict = {}
    names = ("asi", "same", "plain", "notbrace", "arrow", "pattern")
    js = Grammar(ecmascript.JS, ("module", "script"), {p: (lambda t, i, x, p=p: late[p](t, i, x)) for p in names})
    late.update(ecmascript.predicates(js.kinds))
    js.predicates = [(p, late[p]) for p, _ in js.predicates]
    return {
        "py": Language(lex_python, Grammar(PYTHON, ("file",))),
        "json": Language(lex_json, Grammar(JSON, ("file",))),
        "toml": Language(markup.lex_toml, Grammar(markup.TOML, ("file",)), rules=(markup.toml_days_exist, markup.toml_keys_are_new)),
        "xml": Language(markup.lex_xml, Grammar(markup.XML, ("file",)), rules=(markup.xml_tags_match, markup.xml_attributes_are_new, markup.xml_models_are_right, markup.xml_references_are_known)),
        "js": Language(ecmascript.lex_js, js, ("module", "script")),
    }


EXTENSIONS = ("js", "json", "py", "toml", "xml")


def parses(language: str, text: str) -> bool:
    """Whether the whole text is a file of the language: a text of one of its dialects, which run together, that breaks no
    rule of the language."""
    it = languages()[language]
    if language == "js":
        return _parses_js(it, text, False) or (ecmascript._HTML.search(text) is not None and _parses_js(it, text, True))
    got = it.lexer(text, it.grammar.kinds)
    return got is not None and it.grammar.recognise(got[0], it.starts, got[1]) and all(rule(got[1]) for rule in it.rules)


def _parses_js(it: Language, text: str, html: bool) -> bool:
    got = it.lexer(text, it.grammar.kinds, html)
    if got is None:
        return False
    forest: dict = {}
    if not it.grammar.recognise(got[0], it.starts, got[1], forest):
        return False
    early = EarlyErrors(it.grammar, got[0], got[1], forest)
    return any(early.valid(start) for start in forest[None])
