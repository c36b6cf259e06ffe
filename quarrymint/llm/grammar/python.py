"""Python 3.13: lexer and grammar."""

from __future__ import annotations

import io
import re
import tokenize
import unicodedata

#: Parts that are written into the rules below where ``$NAME`` stands, so that one automaton reads them without a call.
_PARTS = {
    "N": "(NAME | '_' | 'match' | 'case' | 'type')",
    "CAPTURE": "(NAME | 'match' | 'case' | 'type')",
    "NAMED": "((WALRUS ':=')? test)",
    "STRINGS": "((STRING | FSTART fpart* FEND)+ | BYTES+)",
    "ATOM": "($N | NUMBER | IMAGINARY | $STRINGS | '...' | 'None' | 'True' | 'False' | '(' (yield | paren)? ')' | '[' list? ']' | '{' braced? '}')",
    "TRAILER": "('(' callargs? ')' | '[' sub (',' sub)* ','? ']' | '.' $N)",
    "PRIMARY": "('await'? $ATOM $TRAILER*)",
    "SIGNED": "(('+' | '-' | '~')* $PRIMARY)",
    "BITS": "($SIGNED (('|' | '^' | '&' | SHIFT | '+' | '-' | '*' | DIVIDE | '@' | '**') $SIGNED)*)",
    "CHAIN": "('not'* $BITS ((('and' | 'or') 'not'* | COMPARE | 'in' | 'not' 'in' | 'is' 'not'?) $BITS)*)",
    "TEST": "($CHAIN ('if' chain 'else' test)? | 'lambda' lparams? ':' test)",
    "STAR": "('*' bits)",
    "STARS": "(($STAR | $TEST) (',' ($STAR | test))* ','?)",
    "RHS": "(yield | $STARS)",
    "TARGET": "($N | '(' tuple? ')' | '[' ($ST (',' $ST)* ','?)? ']' | $MEMBER)",
    "ST": "('*'? target)",
    "MEMBER": "($ATOM $TRAILER* ('.' $N | '[' sub (',' sub)* ','? ']'))",
    "SINGLE": "($N | '(' single ')' | $MEMBER)",
    "EXPRESSION": "($RHS | ('*'? $TARGET (',' $ST)* ','? '=') ($ST (',' $ST)* ','? '=')* $RHS | $SINGLE AUGMENTED $RHS | $SINGLE ':' test ('=' $RHS)?)",
    "AS": "($N ('as' $N)?)",
    "DOTTED": "($N ('.' $N)*)",
    "IMPORT": "('import' $DOTTED ('as' $N)? (',' $DOTTED ('as' $N)?)* | 'from' (('.' | '...')+ $DOTTED? | $DOTTED) 'import' ('*' | '(' $AS (',' $AS)* ','? ')' | $AS (',' $AS)*))",
    "SMALL": "($EXPRESSION | 'del' deleted (',' deleted)* ','? | 'pass' | 'break' | 'continue' | 'return' $STARS? | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') $N (',' $N)* | $IMPORT | 'assert' test (',' test)? | 'type' $N typeparams? '=' test)",
    "POS": "($NAMED | '*' test)",
    "KWS": "(KW '=' test | '*' test)",
    "KWD": "(KW '=' test | '**' test)",
    "ARGS": "($POS (',' $POS)* (',' $KWS)* (',' $KWD)* ','? | $KWS (',' $KWS)* (',' $KWD)* ','? | $KWD (',' $KWD)* ','?)",
    "SN": "($STAR | $NAMED)",
    "PAIR": "(test ':' test | '**' bits)",
    "ITEM": "(test ('as' $ST)?)",
    "SP": "('*' $N | pattern)",
    "SEQ": "($SP ',' ($SP (',' $SP)* ','?)?)",
    "LITERAL": "('-'? NUMBER (('+' | '-') IMAGINARY)? | '-'? IMAGINARY | $STRINGS | 'None' | 'True' | 'False')",
    "KEYED": "(($LITERAL | $N ('.' $N)+) ':' pattern)",
}


def _params(name: str, note: str, star_note: str) -> str:
    """Parameters: those without a default first, up to the star; one slash; names after a bare star."""
    a, d = f"({name} {note})", f"({name} {note} '=' test)"
    both = f"({name} {note} ('=' test)?)"
    first = f"{a} (',' {a})* (',' '/' (',' {a})*)? (',' {d})*"
    second = f"({a} (',' {a})* ',')? {d} (',' {d})* (',' '/' (',' {d})*)?"
    last = f"(',' '**' $N {note})? ','?"
    star = f"'*' $N {star_note} (',' {both})* {last} | '*' (',' {both})+ {last} | '**' $N {note} ','?"
    return f"({first} | {second}) (',' ({star}))? ','? | {star}"


_RULES = f"""
file = (NEWLINE | stmt)* EOF ;
stmt = simple | compound ;
simple = $SMALL (';' $SMALL)* ';'? NEWLINE ;
suite = simple | NEWLINE INDENT stmt+ DEDENT ;
compound = 'if' $NAMED ':' suite ('elif' $NAMED ':' suite)* ('else' ':' suite)? | 'while' $NAMED ':' suite ('else' ':' suite)? | for | try | with | def | class | 'async' (def | for | with) | ('@' $NAMED NEWLINE)+ ('async'? def | class) | match ;
for = 'for' targets 'in' $STARS ':' suite ('else' ':' suite)? ;
try = 'try' ':' suite (('except' (test ('as' $N)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | ('except' '*' test ('as' $N)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite) ;
with = 'with' ($ITEM (',' $ITEM)* | '(' $ITEM (',' $ITEM)* ','? ')') ':' suite ;
def = 'def' $N typeparams? '(' params? ')' ('->' test)? ':' suite ;
class = 'class' $N typeparams? ('(' ($ARGS)? ')')? ':' suite ;
params = {_params("($N | KW)", "(':' test)?", "(':' (test | $STAR))?")} ;
lparams = {_params("($N | KW)", "", "")} ;
typeparams = '[' typeparam (',' typeparam)* ','? ']' ;
typeparam = $N (':' test)? ('=' test)? | '*' $N ('=' (test | $STAR))? | '**' $N ('=' test)? ;
match = 'match' ($NAMED | $SN ',' ($SN (',' $SN)* ','?)?) ':' NEWLINE INDENT case+ DEDENT ;
case = 'case' (pattern | $SEQ) ('if' $NAMED)? ':' suite ;
pattern = closed ('|' closed)* ('as' $CAPTURE)? ;
closed = $LITERAL | $N ('.' $N)* ('(' (pattern (',' pattern)* (',' KW '=' pattern)* ','? | KW '=' pattern (',' KW '=' pattern)* ','?)? ')')? | '(' (pattern | $SEQ)? ')' | '[' ($SP (',' $SP)* ','?)? ']' | '{{' ($KEYED (',' $KEYED)* (',' '**' $CAPTURE)? ','? | '**' $CAPTURE ','?)? '}}' ;
test = $TEST ;
chain = $CHAIN ;
bits = $BITS ;
yield = 'yield' ('from' test | $STARS)? ;
targets = $ST (',' $ST)* ','? ;
target = $TARGET ;
tuple = target | $ST (',' $ST)+ ','? | $ST ',' ;
single = $SINGLE ;
deleted = $N | $MEMBER | '(' (deleted (',' deleted)* ','?)? ')' | '[' (deleted (',' deleted)* ','?)? ']' ;
paren = $NAMED (comp | (',' $SN)* ','?) | $STAR ((',' $SN)+ ','? | ',') ;
list = $NAMED (comp | (',' $SN)* ','?) | $STAR (',' $SN)* ','? ;
braced = $PAIR (',' $PAIR)* ','? | test ':' test comp | $SN (',' $SN)* ','? | $NAMED comp ;
comp = ('async'? 'for' targets 'in' chain ('if' chain)*)+ ;
callargs = $ARGS | $NAMED comp ;
sub = $STAR | WALRUS ':=' test | test (':' test? (':' test?)?)? | ':' test? (':' test?)? ;
fpart = FMIDDLE | '{{' $RHS '='? ('!' $N)? (':' fpart*)? '}}' ;
"""


def _filled(text: str) -> str:
    while "$" in text:
        text = re.sub(r"\$([A-Z]+)", lambda m: _PARTS[m.group(1)], text)
    return text


PYTHON = _filled(_RULES)
_WORDS = set("del pass break continue return raise from global nonlocal assert yield import as if elif else while for in try except finally with def class async lambda and or not is await None True False _".split())
_GROUPS = {o: "AUGMENTED" for o in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()} | {o: "COMPARE" for o in "== != < > <= >=".split()} | {"<<": "SHIFT", ">>": "SHIFT", "//": "DIVIDE", "%": "DIVIDE", "/": "DIVIDE"}
#: A slash that stands for itself between parameters is a division elsewhere.
_SLASH_NEXT = {",", ")", ":"}
_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*")
_STRING = re.compile(r"([a-zA-Z]*)('''|\"\"\"|'|\")(.*)\2", re.DOTALL)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})?|u([0-9a-fA-F]{4})?|U([0-9a-fA-F]{8})?|N(\{[^}]*\})?|.)", re.DOTALL)


def escapes_ok(body: str, is_bytes: bool) -> bool:
    """Whether the escapes of a string that is not raw stand for characters."""
    for m in _ESCAPE.finditer(body) if "\\" in body else ():
        what = m.group()[1]
        if what == "x" and m.group(1) is None:
            return False
        if is_bytes:
            continue
        if what == "u" and m.group(2) is None or what == "U" and (m.group(3) is None or int(m.group(3), 16) > 0x10FFFF):
            return False
        if what == "N":
            try:
                unicodedata.lookup((m.group(4) or "{}")[1:-1])
            except KeyError:
                return False
    return True


def _literal(text: str) -> str | None:
    prefix, _, body = _STRING.fullmatch(text).groups()
    is_bytes = "b" in prefix.lower()
    if is_bytes and not body.isascii() or "r" not in prefix.lower() and not escapes_ok(body, is_bytes):
        return None
    return "BYTES" if is_bytes else "STRING"


def lex_python(text: str, kinds: dict[str, int]):
    """Kinds. A name before ``:=`` is WALRUS, one that starts an argument and stands before ``=`` is KW; ``match``,
    ``case`` and ``type`` are words only where a statement starts."""
    if "\0" in text:
        return None
    out: list[str] = []
    brackets: list[str] = []
    raw: list[bool] = []
    plain_name, before, conversion, slash = False, "NEWLINE", None, False
    start = {"NEWLINE", "INDENT", "DEDENT", ";", ":"}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text.removeprefix("\ufeff")).readline):
            kind, s = t.type, t.string
            if kind == tokenize.COMMENT or kind == tokenize.NL:
                continue
            if conversion is not None:
                if s not in ("s", "r", "a") or t.start != conversion:
                    return None
                conversion = None
            if kind == tokenize.OP:
                if plain_name and s == ":=":
                    out[-1] = "WALRUS"
                elif plain_name and s == "=" and brackets and brackets[-1] == "(" and before in ("(", ","):
                    out[-1] = "KW"
                if s in "([{":
                    brackets.append(s)
                elif s in ")]}" and brackets:
                    brackets.pop()
                elif s in _SLASH_NEXT and slash and before == ",":
                    out[-1] = "/"
                elif s == "!":
                    conversion = t.end
                name = _GROUPS.get(s, s)
            elif kind == tokenize.NAME:
                name = s if s in _WORDS else "NAME"
                if s in ("match", "case", "type") and (not out or out[-1] in start):
                    name = s
            elif kind == tokenize.NUMBER:
                if _ZERO.fullmatch(s):
                    return None
                name = "IMAGINARY" if s[-1] in "jJ" else "NUMBER"
            elif kind == tokenize.STRING:
                name = _literal(s)
            elif kind == tokenize.FSTRING_START:
                raw.append("r" in s.lower())
                name = "FSTART"
            elif kind == tokenize.FSTRING_MIDDLE:
                name = "FMIDDLE" if raw[-1] or escapes_ok(s, False) else None
            elif kind == tokenize.FSTRING_END:
                raw.pop()
                name = "FEND"
            elif kind == tokenize.ENDMARKER:
                name = "EOF"
            else:
                name = tokenize.tok_name[kind]
            if name not in kinds:
                return None
            plain_name = kind == tokenize.NAME and (name == "NAME" or name in ("match", "case", "type", "_"))
            if plain_name or name == "DIVIDE":
                before = out[-1] if out else "NEWLINE"
            elif s == ")" and slash and before == ",":
                out[-1] = "/"
            slash = s == "/"
            out.append(name)
    except (tokenize.TokenError, SyntaxError, ValueError, UnicodeError):
        return None
    return [kinds[x] for x in out], None
