"""ECMAScript, module and script: lexer and grammar. The early errors are in :mod:`early`."""

from __future__ import annotations

import re
from dataclasses import dataclass

_ANY = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null".split()
_SOFT = "as async await from get let of set static yield".split()
_PARTS = {
    "N": "(NAME | " + " | ".join(f"'{w}'" for w in _SOFT) + ")",
    "KEY": "($N | KEYWORD | LITERAL | " + " | ".join(f"'{w}'" for w in _ANY) + ")",
    "PROP": "($KEY | STRING | NUMBER | '[' assign ']')",
    "PRIMARY": "($N | 'this' | 'null' | LITERAL | NUMBER | STRING | REGEX | $TEMPLATE | '(' expression ')' | array | object | function | class)",
    "TEMPLATE": "(TEMPLATE | THEAD expression (TMIDDLE expression)* TTAIL)",
    "HEAD": "($PRIMARY | 'super' ('.' ($KEY | PRIVATE) | '[' expression ']' | '(' args? ')') | 'import' ('(' assign (',' assign)? ','? ')' | '.' $KEY) | new)",
    "TAIL": "('.' ($KEY | PRIVATE) | '[' expression ']' | '(' args? ')')",
    "LEFT": "($HEAD ($TAIL | $TEMPLATE)* (OPTIONAL ($KEY | PRIVATE | '[' expression ']' | '(' args? ')') $TAIL*)*)",
    "MEMBER": "($HEAD ($TAIL | $TEMPLATE)* ('.' ($KEY | PRIVATE) | '[' expression ']') | 'super' ('.' $KEY | '[' expression ']'))",
    "SIMPLE": "($N | '(' simple ')' | $MEMBER)",
    "STEP": "('++' | '--')",
    "POST": "($LEFT | $SIMPLE @same $STEP | $STEP $SIMPLE)",
    "SIGN": "('delete' | 'void' | 'typeof' | '+' | '-' | '!' | '~' | 'await')",
    "BIN": "(BINARY | '*' | 'in' | 'instanceof' | '+' | '-')",
    "OR": "(('&&' | '||') (PRIVATE 'in')?)",
    "QQ": "('??' (PRIVATE 'in')?)",
    "BODY": "'{' body '}'",
    "VARS": "('var' | 'let' | 'const') binding (',' binding)*",
    "BOUND": "($N | bpattern)",
    "SPEC": "($N | ($KEY | STRING) 'as' $N)",
    "NAMED": "('{' ($SPEC (',' $SPEC)* ','?)? '}')",
    "NS": "('*' 'as' $N)",
    "WITH": "('with' object)?",
    "OUT": "($KEY | STRING)",
}


def _chain(ops: str) -> str:
    return f"(($POST ({ops} | POWER) | $SIGN $SIGN* $POST {ops})* ($POST | $SIGN $SIGN* $POST))"


_RULES = f"""
script = body EOF ;
module = (importdecl | exportdecl | item)* EOF ;
body = item* ;
importdecl = 'import' (STRING | ($N (',' ($NS | $NAMED))? | $NS | $NAMED) 'from' STRING) $WITH semi ;
exportdecl = 'export' ('*' ('as' $OUT)? 'from' STRING $WITH semi | '{{' (espec (',' espec)* ','?)? '}}' ('from' STRING $WITH)? semi | function | class | variables semi | 'default' (function | class | @plain assign semi)) ;
espec = $OUT ('as' $OUT)? ;
semi = ';' | @asi ;
item = lexical semi | function | class | statement ;
lexical = ('let' | 'const') binding (',' binding)* ;
variables = $VARS ;
statement = block | 'var' binding (',' binding)* semi | ';' | if | loop | jump semi | 'with' '(' expression ')' statement | switch | 'throw' @same expression semi | try | 'debugger' semi | labelled | @plain expression semi ;
block = $BODY ;
sub = statement | function ;
if = 'if' '(' expression ')' sub ('else' sub)? ;
labelled = $N ':' sub ;
jump = 'continue' (@same $N)? | 'break' (@same $N)? | 'return' (@same expression)? ;
loop = 'while' '(' expression ')' statement | 'do' statement 'while' '(' expression ')' ';'? | 'for' '(' (variables | expression)? ';' expression? ';' expression? ')' statement | 'for' '(' (('var' | 'let' | 'const') $BOUND | $SIMPLE | apattern) ('of' assign | 'in' expression) ')' statement | 'for' 'await' '(' (('var' | 'let' | 'const') $BOUND | $SIMPLE | apattern) 'of' assign ')' statement | 'for' '(' 'var' $N '=' assign 'in' expression ')' statement ;
switch = 'switch' '(' expression ')' '{{' cases '}}' ;
cases = ('case' expression ':' item*)* ('default' ':' item* ('case' expression ':' item*)*)? ;
try = 'try' block (catch ('finally' block)? | 'finally' block) ;
catch = 'catch' ('(' $BOUND ')')? $BODY ;
binding = $N ('=' assign)? | bpattern '=' assign ;
bpattern = '[' (',' | belem ',')* (belem | '...' $BOUND)? ']' | '{{' (bprop ',')* (bprop | '...' $N)? '}}' ;
belem = $BOUND ('=' assign)? ;
bprop = $N ('=' assign)? | $PROP ':' belem ;
apattern = '[' (',' | aelem ',')* (aelem | '...' ($SIMPLE | apattern))? ']' | '{{' (aprop ',')* (aprop | '...' $SIMPLE)? '}}' ;
aelem = ($SIMPLE | apattern) ('=' assign)? ;
aprop = $N ('=' assign)? | $PROP ':' aelem ;
function = ('async' @same)? 'function' '*'? $N? '(' params ')' $BODY ;
params = (belem (',' belem)* (',' '...' $BOUND | ',')? | '...' $BOUND)? ;
class = 'class' $N? ('extends' left)? '{{' member* '}}' ;
left = $LEFT ;
member = ';' | 'static'? method | 'static'? ($PROP | PRIVATE) ('=' assign)? semi | 'static' $BODY ;
method = 'get' ($PROP | PRIVATE) '(' ')' $BODY | 'set' ($PROP | PRIVATE) '(' belem ')' $BODY | ('async' @same)? '*'? ($PROP | PRIVATE) '(' params ')' $BODY ;
expression = assign (',' assign)* ;
assign = @arrow arrow | 'yield' (@same '*'? assign)? | $SIMPLE ('=' | ASSIGN) assign | @pattern apattern '=' assign | conditional ;
arrow = ('async' @same)? ($N | '(' params ')') @same '=>' ($BODY | @notbrace assign) ;
conditional = (PRIVATE 'in')? ({_chain("($BIN | $OR)")} | {_chain("($BIN | $QQ)")}) ('?' assign ':' assign)? ;
simple = $SIMPLE ;
new = 'new' ('.' $KEY | ($PRIMARY | new | 'super' ('.' $KEY | '[' expression ']') | 'import' '.' $KEY) ('.' ($KEY | PRIVATE) | '[' expression ']' | $TEMPLATE)* ('(' args? ')')?) ;
args = ('...'? assign) (',' '...'? assign)* ','? ;
array = '[' (',' | '...'? assign ',')* ('...'? assign)? ']' ;
object = '{{' (entry (',' entry)* ','?)? '}}' ;
entry = '...' assign | $N | $PROP ':' assign | method ;
"""


def _filled(text: str) -> str:
    while "$" in text:
        text = re.sub(r"\$([A-Z]+)", lambda m: _PARTS[m.group(1)], text)
    return text


JS = _filled(_RULES)


@dataclass
class Tokens:
    """What predicates and early errors look at: a line break before each token, its text, the place of its closing bracket,
    and whether comments of the kind that only scripts have were seen."""

    breaks: list[bool]
    texts: list[str]
    close: dict[int, int]
    html: bool = False


_JS_WORDS = {*_ANY, *_SOFT}
_JS_ASSIGN = set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_JS_BINARY = set("== != === !== < > <= >= << >> >>> / % & | ^".split())
_JS_SPACE = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.DOTALL)
_JS_ESCAPE = r"\\(?:u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\})"
_JS_TOKEN = re.compile(
    rf"(?P<NAME>(?:[^\W\d]|\$|{_JS_ESCAPE})(?:[\w$\u200c\u200d]|{_JS_ESCAPE})*)"
    r"|(?P<NUMBER>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-9]+|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))"
    r"|(?P<STRING>\"(?:[^\"\\\n\r]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu]))*\"|'(?:[^'\\\n\r]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu]))*')"
    rf"|(?P<PRIVATE>\#(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<OP>\?\.(?!\d)|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|\+\+|--|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.])",
    re.DOTALL,
)
_JS_REGEX = re.compile(r"/((?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([\w$]*)")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.DOTALL)
_JS_VALUE_WORDS = set("this null super as async from get let of set static".split())
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|[1-9]|0[0-9])")
_PAIRS = re.compile(r"\\\\")
_HTML = re.compile(r"<!--|-->")


def lex_js(text: str, kinds: dict[str, int], html: bool = False):
    """Kinds and :class:`Tokens`. A slash is a division after a value, else it opens a regular expression; a closing
    parenthesis or brace is a value by what stood before its opening one. With ``html`` the comments that only scripts have
    are comments."""
    out, breaks, texts, close, at, n = [], [], [], {}, 0, len(text)
    info = Tokens(breaks, texts, close)
    if text.startswith("#!"):
        at = min([i for i in (text.find("\n"),) if i >= 0] or [n])
    value, stack = False, []  # stack: (bracket, is the closed whole a value, its place)
    last = ""

    def put(kind: str, s: str) -> None:
        out.append(kinds[kind])
        breaks.append(newline)
        texts.append(s)

    newline = True
    while True:
        first, newline = newline and not out, False
        while True:
            m = _JS_SPACE.match(text, at)
            gap = text[at : m.end()]
            newline = newline or "\n" in gap or "\r" in gap or "\u2028" in gap or "\u2029" in gap
            at = m.end()
            if html and (text.startswith("<!--", at) or ((newline or first) and text.startswith("-->", at))):
                info.html = True
                at = min([i for i in (text.find("\n", at), text.find("\r", at)) if i >= 0] or [n])
                continue
            break
        if at >= n:
            newline = True
            put("EOF", "")
            return None if stack else (out, info)
        ch = text[at]
        if ch == "`" or (ch == "}" and stack and stack[-1][0] == "`"):
            m = _JS_TEMPLATE.match(text, at + 1)
            if not m:
                return None
            opened, closed = m.group(1) == "${", ch == "`"
            tagged = value and last not in ("++", "--") if closed else stack[-1][1]
            if not tagged and _BAD_ESCAPE.search(_PAIRS.sub("  ", m.group())):
                return None
            if not closed:
                stack.pop()
            kind = ("THEAD" if opened else "TEMPLATE") if closed else ("TMIDDLE" if opened else "TTAIL")
            if opened:
                stack.append(("`", tagged, len(out)))
            at, value, last = m.end(), not opened, kind
            put(kind, "")
            continue
        if ch == "/" and not value:
            m = _JS_REGEX.match(text, at)
            if not m or not regex_ok(m.group(1), m.group(2)):
                return None
            at, value, last = m.end(), True, "REGEX"
            put("REGEX", "")
            continue
        m = _JS_TOKEN.match(text, at)
        if not m:
            return None
        at, kind, word = m.end(), m.lastgroup, m.group()
        if kind == "NAME":
            if last in (".", "OPTIONAL"):
                value = True
            else:
                value = word not in _JS_WORDS or word in _JS_VALUE_WORDS
            if word in ("true", "false"):
                kind = "LITERAL"
            elif word == "enum":
                kind = "KEYWORD"
            elif word in _JS_WORDS:
                kind = word
            elif "\\" in word and re.sub(r"\\u\{?([0-9a-fA-F]+)\}?", lambda x: chr(int(x.group(1), 16) % 0x110000), word) in _JS_WORDS:
                return None
        elif kind == "OP":
            kind = "POWER" if word == "**" else "ASSIGN" if word in _JS_ASSIGN else "BINARY" if word in _JS_BINARY else "OPTIONAL" if word == "?." else word
            if word in "([":
                stack.append((word, not (word == "(" and last in ("if", "while", "for", "with")), len(out)))
                value = False
            elif word == "{":
                stack.append((word, last in ("(", "[", ",", "=", ":", "?", "ASSIGN", "BINARY", "&&", "||", "??", "return", "...", "+", "-"), len(out)))
                value = False
            elif word in ")]}":
                if not stack or stack[-1][0] != {")": "(", "]": "[", "}": "{"}[word]:
                    return None
                _, value, opening = stack.pop()
                close[opening] = len(out)
            else:
                value = word in ("++", "--") and value
        else:
            value = True
        if kind not in kinds:
            return None
        last = kind
        put(kind, word)


_CLASS_ESCAPE = re.compile(r"\\(?:[dDsSwW]|[pP](?:\{[^}]*\})?|c[A-Za-z]?|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|.)", re.DOTALL)
_QUANTIFIER = re.compile(r"[*+?]\??|\{(\d+)(,(\d*))?\}\??")
_GROUP = re.compile(r"\?(?:[:=!]|<[=!]|<([A-Za-z_$][\w$]*)>|[ims]*(?:-[ims]*)?:)")


def regex_ok(body: str, flags: str) -> bool:
    """Whether a regular expression is one: groups, quantifiers, ranges, names and flags."""
    if set(flags) - set("dgimsuvy") or len(set(flags)) < len(flags) or {"u", "v"} <= set(flags):
        return False
    strict = "u" in flags or "v" in flags
    names = re.findall(r"\(\?<([A-Za-z_$][\w$]*)>", body)
    groups, at, atom, n = [], 0, False, len(body)
    while at < n:
        ch = body[at]
        if ch == "\\":
            m = _CLASS_ESCAPE.match(body, at)
            if not m:
                return False
            e = m.group()
            if e[1] == "k" and (strict or names):
                m = re.compile(r"\\k<([\w$]+)>").match(body, at)
                if not m or m.group(1) not in names:
                    return False
            elif strict and (e[1:] in ("x", "u", "c", "p", "P") or (e[1].isalpha() and len(e) == 2 and e[1] not in "dDsSwWbBfnrtv")):
                return False
            at, atom = m.end(), e[1] not in "bB"
        elif ch == "[":
            at += 1
            if body.startswith("^", at):
                at += 1
            depth, held = 1, None
            while at < n and depth:
                if body[at] == "\\":
                    m = _CLASS_ESCAPE.match(body, at)
                    item = m.group()
                    at = m.end()
                elif body[at] == "]":
                    depth -= 1
                    at += 1
                    continue
                elif body[at] == "[" and "v" in flags:
                    depth += 1
                    at += 1
                    continue
                else:
                    item = body[at]
                    at += 1
                if held is not None and len(held) == 1 and len(item) == 1 and held > item:
                    return False
                held = None
                if at + 1 < n and body[at] == "-" and body[at + 1] != "]" and "v" not in flags:
                    held = item if len(item) == 1 else None
                    if held is None:
                        continue
                    at += 1
            if depth:
                return False
            atom = True
        elif ch == "(":
            m = _GROUP.match(body, at + 1)
            if body.startswith("?", at + 1) and not m:
                return False
            groups.append(m.group() if m else "")
            at, atom = (m.end() if m else at + 1), False
        elif ch == ")":
            if not groups:
                return False
            kind = groups.pop()
            at, atom = at + 1, not (kind in ("?<=", "?<!") or (strict and kind in ("?=", "?!")))
        elif ch in "*+?" or (ch == "{" and _QUANTIFIER.match(body, at)):
            m = _QUANTIFIER.match(body, at)
            if not atom or (m.group(3) and int(m.group(1)) > int(m.group(3))):
                return False
            at, atom = m.end(), False
        elif strict and ch in "{}]":
            return False
        else:
            at, atom = at + 1, ch not in "^$|"
    return not groups and ("|" in body or len(set(names)) == len(names))


def predicates(kinds: dict[str, int]) -> dict:
    brace, end, opening, arrow, is_paren = kinds["}"], kinds["EOF"], kinds["{"], kinds["=>"], kinds["("]
    starts = {kinds[w] for w in ("{", "function", "class")}
    is_async, is_function, is_let, bracket, is_equal = kinds["async"], kinds["function"], kinds["let"], kinds["["], kinds["="]

    def plain(t, p, x):
        return not (t[p] in starts or (t[p] == is_async and t[p + 1] == is_function and not x.breaks[p + 1]) or (t[p] == is_let and t[p + 1] == bracket))

    def is_arrow(t, p, x):
        if t[p] == is_async and t[p + 1] != arrow:
            p += 1
        return t[x.close.get(p, p) + 1] == arrow if t[p] == is_paren else t[p + 1] == arrow

    return {
        "asi": lambda t, p, x: p < len(t) and (x.breaks[p] or t[p] == brace or t[p] == end),
        "same": lambda t, p, x: not x.breaks[p],
        "plain": plain,
        "notbrace": lambda t, p, x: t[p] != opening,
        "arrow": is_arrow,
        "pattern": lambda t, p, x: t[x.close.get(p, p) + 1] == is_equal,
    }
