import ast
import json
import random
import re
import tomllib
import warnings
from xml.parsers import expat

import pytest
from pyspark.sql import functions as F

from quarrymint.llm.grammar.gll import Grammar
from quarrymint.llm.grammar.languages import parses
from quarrymint.llm.parsing import check_sources, rates

warnings.simplefilter("ignore", SyntaxWarning)
GOOD = {
    "py": ["", "x = 1\n", "match = 2\nmatch x:\n    case [1, *r] | {'a': b, **k} if b: pass\n", "with (open(a) as f, b as g):\n    pass\n", "f'{x!r:>{w}} {y=}'\n", "def f[T: int](a, /, b=1, *c, d: 'x' = 2, **e) -> T:\n    return lambda *z, q=1: (yield)\n", "async def f():\n    async with a as b: await c\n    return [x async for x in y if x]\n", "type X[T] = list[T]\n", "try:\n  pass\nexcept* (A, B) as e:\n  pass\nelse:\n  pass\nfinally:\n  pass\n", "x: int = 3; a = b = *c, d\nx[1:2, ::3, *y] += not z if w else ~v ** -2\n", "@a.b(c)\nclass D(E, metaclass=F): x = {**a, 'b': 1}\n", "if (n := 10) > 5: print(*a, k=1, **b)\n", "print(f(x for x in y))\n", "def f(): pass"],
    "json": ["1", "[]", ' {"a": [1, -2.5e3, "x\\u00e9\\n", true, null]} '],
    "toml": ["", "a = 1\n", "a.'b c'.\"d\" = [1, 2, # c\n 3,\n]\n[t]\nx = {y = 1, z = 'q'}\n[[u.v]]\nd = 1979-05-27T07:32:00Z\ns = '''\n[x'''\nm = \"\"\"a\\\n  b\"\"\"\nf = -1_0.5e+3\n"],
    "xml": ["<a/>", "<?xml version='1.0'?>\n<!-- x --><a b=\"1\" c='&lt;'>t &amp; &#65;<b><![CDATA[<<]]></b><?pi x?></a>\n"],
    "js": ["", "'use strict';\nlet a = 1, {b, c: [d], ...e} = f\n", "import x, {y as z} from 'm';\nexport default class extends A { #p = 1; static { } get q() { return this.#p } async *r() {} }\nexport { x as 'y' };\n", "a = b\n++c\n", "for (const [k, v] of m) { if (k) continue; else break }\nfor (let i = 0, n = 3; i < n; i++) ;\nfor (x in y) ;\n", "const f = async (a, {b} = {}, ...c) => { await a?.b?.[0]?.(c) ?? d };\n", "x = `a ${b + `c ${d}`} e`.replace(/[/)]+/g, '') / 2 / 3;\n", "do x++; while (x < 5) y()\n", "switch (a) { case 1: default: break }\ntry { } catch { } finally { }\nlabel: while (1) break label\n", "function* g() { yield* a; yield }\nnew A.B(1, ...c).d\n", "var o = { a, b: 1, 'c'() {}, get d() { return 1 }, async e() {}, [f]: 2, ...g }\n", "with (a) b()\n", "if (a) /x/.test(b)\n", "return_ = a ? b : c => d\n"],
}
BAD = {
    "py": ["def f(:\n", "x = (1,\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n=======\ny = 2\n>>>>>>> b\n", "x = 'a\n", "  x = 1\n y = 2\n", "print 'x'\n", "{\"a\": 1,\n", "x = 012\n", "f'{x'\n"],
    "json": ["", "{", "{'a': 1}", "[1,]", "NaN", "{\"a\": 1} x", "01", '"a\nb"'],
    "toml": ["a", "a = ", "[t", "a = 1 b = 2\n", "a = {b = 1,}\n", "a = 'x\n", "=======\n"],
    "xml": ["<a>", "<a></a><b/>", "text", "<a b=1/>", "<a>&</a>", "<a b='<'/>", "<a", "<a><!-- -- --></a>"],
    "js": ["{", "function f( { }", "let = = 1", "a b", "x = 'a\n'", "class A { b c }", "}", "{\n  \"a\": 1,\n  \"b\": 2\n}\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "def f(x):\n  return x\n", "import { a from 'b'", "`a ${b", "if (a) else b", "for (;;", "const x;y = )"],
}


@pytest.mark.parametrize("language", GOOD)
def test_grammar_takes_valid_files(language):
    assert [t for t in GOOD[language] if not parses(language, t)] == []


@pytest.mark.parametrize("language", BAD)
def test_grammar_rejects_damaged_files(language):
    assert [t for t in BAD[language] if parses(language, t)] == []


ALSO_GOOD = {
    "py": ["f(x for x in y)", "def f(a, /, b=1, *c, d, **e): pass", "x = *a, b = c", "not a == b", "(x := 1)", "a[b := 1, *c]", "match x:\n case {'a': 1, **r} | A(b, c=_): pass\n", "match = type = case = 1", "type X[T: int, *Ts = *U] = int", "'\\N{DIGIT ONE}'", "del (a, [b.c]), d[0]", "try: pass\nexcept* A as e: pass\n", "f'{x!r:>{w}}{{}}'", "lambda *, a: 0", "x = yield"],
    "js": ["for(;;) break", "async function f(){ await x; for await (a of b) ; }", "await x", "var a; var a", "{ function f(){} function f(){} }", "function f(a, a){}", "function* g(){ yield; yield* a; x = yield b }", "var yield = 1; yield * 2", "var await = 1; await * 2", "class A extends B { constructor(){ super(); super.x } #a = 1; m(){ return #a in this && this.#a } static { this.y = super.z } }", "class A { get #a(){} set #a(x){} }", "function F(){ new.target }", "let x; export {x, x as y}", "a: for(;;) { for(;;) continue a }", "try {} catch (e) { var e }", "x = {__proto__: 1, __proto__}", "<!-- c\nx\n--> d", "if (a) function f(){}", "010 + '\\01'", "x = async function* () { yield await z }", "[a, b.c] = [b, a]; ({a, b: c.d} = e)", "y = /[/\\]]+(?:a|b){1,2}(?<n>x)\\k<n>/giu.test(z)", "async () => { for await (x of y); }", "f`\\u{`", "import def from './x.js' with { type: 'json' }\nexport default def\n"],
    "toml": ["[a.b.c]\n[a]\nb.d = 1", "a.b = 1\na.c = 2", "[t]\na.b.c = 1\n[t.a.q]\nz = 1", "[[a]]\n[a.b]\n[[a]]\n[a.b]", "a = {x.y = 1, x.z = 2}", "a = [{b = 1}, {b = 2}]"],
    "xml": ["<!DOCTYPE a [<!ENTITY foo 'x'><!ELEMENT a (b|c)*><!ATTLIST a x CDATA #IMPLIED>]><a>&foo;</a>", "<!DOCTYPE a SYSTEM 'x'><a>&foo;</a>"],
}
ALSO_BAD = {
    "py": ["f() = 1", "del f()", "a, b += 1", "f(x for x in y, 1)", "def f(a=1, b): pass", "{**a for a in b}", "yield = 1", "f(a=1, b)", "f(**k, *a)", "(*a)", "a + not b", "a or lambda: 1", "def f(*): pass", "def f(/): pass", "x := 1", "[y for y in x if z := y]", "{a: b, c}", "[*a for a in b]", "for f() in x: pass", "try: pass\nexcept A, B: pass", "try: pass\nexcept* A: pass\nexcept B: pass", "match x:\n case y as _: pass\n", "match x:\n case *a: pass\n", "from x import a,", "(a, b): int", "f'{x!z}'", "f'{}'", "'a' b'b'", "b'\u00e9'", "'\\x1'", "'\\N{foo}'", "None = 1", "class A(x for x in y): pass", "f(a.b=1)", "del *a"],
    "js": ["1 = 2", "const a;", "return 1", "break;", "function f(){ await x }", "async () => { await x }; () => { for await (x of y); }", "let a; let a;", "/(/", "/a/gg", "class A { constructor(){} constructor(){} }", "let x; export {x}; export {x}", "export {y}", "a: a: b", "super.x", "a: { continue a }", "for(;;){ function f(){ break } }", "let a; { var a }", "function f(a){ let a }", "(a, a) => 1", "'use strict'; with(a) b", "function f(a=1){'use strict'}", "function* g(){ var yield }", "async function f(){ (await) }", "x = {__proto__: 1, '__proto__': 2}", "class A { m(){ this.#b } }", "class A { #a; #a }", "class A { constructor(){ super() } }", "new.target", "class A { static prototype(){} }", "if (a) class B {}", "while (1) let x", "try {} catch (e) { let e }", "switch (a) { case 1: let b; case 2: let b }", "a ?? b || c", "-a ** b", "({a = 1})", "let [...a,] = d", "`\\u{`", "a?.b = 1", "switch(a){default: default: }", "import a from 'b'; let a"],
    "toml": ["a = 1\na = 2", "[a]\n[a]", "[a.b]\n[a]\nb.c = 1", "a.b = 1\n[a.c]\n[a]", "a = []\n[[a]]", "a = {x = 1}\n[a.b]", "a = [{b = 1, b = 2}]", "[t]\na.b.c = 1\n[t.a]", "a = 2020-02-30", "a = 25:00:00", "'a' = 1\n\"\\u0061\" = 2", "a = \"\\ud800\"", "a = \"\"\"x\rb\"\"\""],
    "xml": ["<a><b></a></b>", "<a b='1' b='2'/>", "<a>&foo;</a>", "<a>&#0;</a>", "<a>]]></a>", "<a><!-- a --- b --></a>", " <?xml version='1.0'?><a/>", "<a\u00a0b='1'/>", "<a b='c'd='e'/>"],
}


@pytest.mark.parametrize("language", ALSO_GOOD)
def test_rules_pass_valid_files(language):
    assert [t for t in ALSO_GOOD[language] if not parses(language, t)] == []


@pytest.mark.parametrize("language", ALSO_BAD)
def test_rules_find_what_no_grammar_says(language):
    assert [t for t in ALSO_BAD[language] if parses(language, t)] == []


def own_verdict(language, text):
    try:
        if language == "py":
            ast.parse(text)
        elif language == "toml":
            tomllib.loads(text)
        else:
            expat.ParserCreate("utf-8").Parse(text.encode(), True)
    except (SyntaxError, ValueError, expat.ExpatError):
        return False
    return True


@pytest.mark.parametrize("language", ["py", "toml", "xml"])
def test_damaged_files_are_judged_as_by_the_languages_own_parsers(language):
    rnd = random.Random(6)
    cells = re.compile(r"\w+|\s|[^\w\s]")
    texts = GOOD[language] + ALSO_GOOD[language] + ALSO_BAD[language]
    spare = [c for t in texts for c in cells.findall(t)]
    seen = [0, 0]
    for _ in range(3000):
        parts = cells.findall(rnd.choice(texts)) or [" "]
        for _ in range(rnd.choice([1, 1, 2, 3])):
            at = rnd.randrange(len(parts))
            parts[at] = rnd.choice(["", rnd.choice(spare), parts[at] + rnd.choice(spare), parts[rnd.randrange(len(parts))]])
        text = "".join(parts)
        if language == "xml" and "<?xml" in text:
            continue  # that parser takes any version
        want = own_verdict(language, text)
        seen[want] += 1
        assert parses(language, text) == want, text
    assert min(seen) > 100


def test_examples_agree_with_the_languages_own_parsers():
    own = {"py": ast.parse, "json": json.loads, "toml": tomllib.loads}
    for language, read in own.items():
        for text in GOOD[language]:
            read(text)
        for text in BAD[language]:
            if text != "NaN":
                with pytest.raises((SyntaxError, ValueError)):
                    read(text)


def test_the_operator_calls_no_other_parser():
    import quarrymint.llm.parsing as parsing

    assert not {"ast", "json", "tomllib", "expat"} & set(vars(parsing))


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("s = e EOF ; e = e '+' e | 'a' ; d = 'a' 'a' EOF ;", ("s", "d"))
    k = g.kinds
    text = [x for _ in range(40) for x in (k["a"], k["+"])][:-1] + [k["EOF"]]
    assert g.recognise(text, ("s",)) and not g.recognise(text[:-2] + [k["EOF"]], ("s",))
    assert g.recognise([k["a"], k["a"], k["EOF"]], ("s", "d")) and not g.recognise([k["a"], k["a"], k["EOF"]], ("s",))


def test_operator(spark):
    rows = [(1, "r", "a/B.PY", "x = 1\n", "x = (\n"), (2, "r", "b.json", None, " \n"), (3, "r", "c.md", "(", "("), (4, None, None, "x", "x"), (5, "s", "d.xml", "<a><b></a></b>", "<a/>"), (6, "s", "e.toml", "a = 1\na = 2\n", "a = 1"), (7, "s", "f.py", "f() = 1\n", "x" * 200_000)]
    df = spark.createDataFrame(rows + rows[:1], "valid long, side string, p string, b string, a string").withColumn("text", F.lit("clash"))
    got = check_sources(df, "valid", "p", (("before", "b"), ("after", "a")), ["side"])
    assert {(r["valid_"], r["side"]) for r in got.where("not valid").collect()} == {(1, "after"), (5, "before"), (6, "before"), (7, "before")}
    out = {r["language"]: (r["sources"], r["invalid"], r["rate"]) for r in rates(got, "valid_", ["language"]).collect()}
    assert out["py"] == (4, 2, 0.5) and "json" not in out
    assert check_sources(df.where("false"), "valid", "p", (("before", "b"),)).count() == 0
