import ast
import glob
import os

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import pairs, parsing, provenance
from quarrylens.llm.syntax.check import first_error
from quarrylens.llm.syntax.engine import Grammar


def messy(df):
    return df.select("*", *[F.lit("clash").alias(c.upper()) for c in df.columns])


DISCOVERED = "file_id long, repo string, path string, lang string, hash string, mtime long, content string"
HAND = "import logging\n\ndef run(a, b):\n    return a * 3 + b\n\nclass Desk:\n    level = 4\n"
FIELDS = "\n".join(f"def get_field_{i:03d}(f):\n    return f[{i}]" for i in range(3, 40))

PROVENANCE = [
    ("app/a.py", "python", HAND, None),
    ("app/a.py", "python", "# Copyright 2020 Us\n# Code generated by ormgen. DO NOT EDIT.\n" + HAND, "generated"),
    ("app/a.py", "python", HAND + "\n# @generated by stubsmith 3.7\n", "generated"),
    ("app/a.py", "python", "# This module used to be generated; since release 4 it is kept by hand.\n" + HAND, None),
    ("app/a.py", "python", 'MARK = "Code generated by this writer. DO NOT EDIT."\n' + HAND, None),
    ("src/A.java", "java", "/**\n * Auto-generated method stub\n */\nclass A { int f() { return 1; } }\n", None),
    ("app/f.py", "python", FIELDS, "generated"),
    ("vendor/lib/x/a.py", "python", HAND, "vendored"),
    ("app/vendor/rating/a.py", "python", HAND, None),
    ("web/assets/vendor/jquery/jquery.js", "javascript", "var a = 1;\n", "vendored"),
    ("src/external/zlib/inflate.c", "c", "int x = 1;\n", "vendored"),
    ("lib/deps/parser-2.4.1/x.py", "python", HAND, "vendored"),
    ("deps/report.py", "python", HAND, None),
    ("external/api_client.py", "python", HAND, None),
    ("external/zlib/part/inflate.py", "python", HAND, "vendored"),
    ("src/deps/solver/order.py", "python", HAND, None),
    ("app/a.py", "python", "# Do not edit prices here by hand.\n" + HAND, None),
    ("app/a.py", "python", "# Please do not edit the totals while a run is open.\n" + HAND, None),
    ("app/a.py", "python", "# DO NOT EDIT\n" + HAND, "generated"),
    ("app/a.py", "python", "# Do not modify this file by hand.\n" + HAND, "generated"),
    ("app/a.py", "python", "# Nicht bearbeiten!\n" + HAND, "generated"),
    ("app/minimum_stock/bundle_price.js", "javascript", "import { a } from './b';\nconst f = (x) => {\n    return x + a;\n};\n", None),
    ("public/x.min.js", "javascript", "var a=1;", "generated"),
    ("public/x.js", "javascript", "".join(f"function f{i}(a,b){{var c=a*{i};if(c>b)return b;return c}}" for i in range(20)), "minified"),
    ("libs/q.py", "python", "# kafatudu v4.8.0\n# (c) 2012 The kafatudu Authors. Released under the MIT licence.\n" + HAND, "vendored"),
    ("app/d.py", "python", "ROWS = [\n" + "".join("    " + ", ".join(str(1000 + 7 * i + k) for k in range(12)) + ",\n" for i in range(20)) + "]\n", "data"),
    ("vendor/e.py", "python", "", None),
    ("vendor/e.py", "python", "# only a comment\n", None),
    ("lib/o.php", "php", "<?php\n", None),
    ("node_modules/x/y.js", "javascript", None, "vendored"),
    ("app/x.js", "javascript", None, None),
    (None, None, HAND, None),
]


@pytest.mark.parametrize("path,lang,content,kind", PROVENANCE)
def test_judging_files(path, lang, content, kind):
    assert provenance.judge(path, lang, content) == kind


def test_copies_in_several_repositories(spark):
    rows = [(1, "r", "app/a.py", "python", "H1", 1, HAND), (2, "q", "app/b.py", "python", "h9", 1, HAND.replace("\n", "\r\n")), (3, "r", "app/c.py", "python", "h2", 1, HAND + "x = 1\n"), (4, "r", "e.py", "python", "h3", 1, ""), (5, "q", "e.py", "python", "h3", 1, ""), (6, "r", "app/g.py", "python", "h4", 1, HAND + "y = 2\n"), (6, "r", "app/g.py", "python", "h4", 1, HAND + "y = 2\n"), (None, None, None, None, None, None, None)]
    found = spark.createDataFrame(rows, DISCOVERED)
    files = spark.createDataFrame([("z", "H4"), ("r", "h4"), ("r", "h2"), (None, None)], "repo string, hash string")
    assert sorted(r.file_id for r in provenance.found(messy(found), messy(files)).collect()) == [1, 2, 6]
    assert provenance.found(found.where("false"), files.where("false")).count() == 0


VALID = {
    "python": ["", "# x\n", "match x:\n    case {'a': [1, *r]} if r: pass\n    case P(q=3) | None: pass\n", "async def f(a, /, b: int = 3, *c, d, **e) -> dict[str, int]:\n    async with a as b, c: pass\n    return {k: v async for k, v in b if (n := v)}\n", "x = f'{a!r:>{w}}' \"b\"\nlambda *a, k=1: (yield)\n@d(1)\nclass A[T](B, metaclass=M):\n    x: int = 3\n    def f(self): return not self\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse:\n  del a[1:2, ...], b\nfinally:\n  global z\n", "if a:\n\tb\n\n  # odd comment\nelif c: d; e\n", "print(*a, sep='')\nx = [i for i in range(3) if i if j]\na, *b = c\nwhile 1: break\n"],
    "javascript": ["import a, { b as c } from './d.js';\nexport default class extends A { #p = 1; static x = 2; get y() { return this.#p } static { f() } }\n", "const f = async ({a, b: [c] = []}, ...r) => ({ ...a, [b]: `x${c ? `${r}` : ''}y` })\nlet g = x => x?.y?.[0] ?? 1\nfor (const [k, v] of o) { if (k in v) continue; else break }\n", "var r = /[/]\\/(a|b)+/gi.test(s) ? a / b / c : d\nlabel: while (i--) switch (x) { case 1: default: y() }\n", "!function(a,b){return a+b}(1,2);new A;a = b\n++c\nthrow e\n", "try { f() } catch { g() } finally { h() }\ndo x++; while (x < 5)\nexport { a as b, c }; export * from 'd'\n"],
    "typescript": ["interface A<T extends B = C> extends D<T> { readonly x?: number; f(a: string, ...b: T[]): void; [k: string]: any; new (x: A): B }\ntype U = { [K in keyof A]?: A[K] } | `x${string}` | ((a: number) => a is B) | [a: string, b?: C];\nenum E { A = 1, B = 'x' }\n", "abstract class A<T> extends B<T> implements C { private constructor(readonly x: number, protected y?: string) { super() } static async *f<T>(this: A, a?: T): AsyncGenerator<T> { yield* g<T>(a!) } abstract h(): void; declare z: string }\n", "export const f = <T,>(a: T, b = 2): Promise<T> => a as unknown as Promise<T>;\nfunction g(a: string): string;\nfunction g(a: any) { return a satisfies any }\nimport type { X } from './x';\ndeclare module 'm' { export function q(): void }\n@dec() class D { @p() m(@i() a: A) {} }\n", "let x: A['b'][] = (<any>y).z; const t: unique symbol = s; if (a < b && c > d) f<A>(1)\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class Q<T extends B & C> extends D<T[]> implements E {\n  static { x = 1; }\n  private final Map<String, List<? super T>> m = new HashMap<>() {{ put(\"a\", null); }};\n  public <R> Q(int... a) throws X { this(); }\n  abstract int f(final int[] a[]);\n}\n", "sealed interface S permits A, B {}\nrecord A(int x, @N String... y) implements S { A { if (x < 0) throw new E(); } }\nenum E { X(1) { void f() {} }, Y; E(int... i) {} }\n", "class A { int f(Object o) { var s = switch (o) { case Integer i when i > 3 -> i; case A(var x, int y) -> { yield 2; } default -> throw new X(); }; for (int i = 0, j = 1; i < (int) 3L >>> 1; i++, --j) continue; for (String q : l) ; try (var r = g(); r2) { } catch (A | B e) { } finally { } return a instanceof B b && b.c ? A::new : (x, y) -> x + y; } String t = \"\"\"\n a \"q\"\n \"\"\"; char c = '\\u0041'; }\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S[T any, U ~int | string] struct {\n\tA, b int `json:\"a\"`\n\t*E\n\tm map[string][]func(int) (T, error)\n}\n\nfunc (s *S[T, U]) F(a, b int, c ...string) (r T, err error) {\n\tdefer func() { recover() }()\n\tif v, ok := s.m[\"a\"]; !ok || len(v) > 3 {\n\t\treturn\n\t}\n\tfor i := range 10 {\n\t\tswitch x := s.b.(type) {\n\t\tcase int, *T:\n\t\t\tbreak\n\t\tdefault:\n\t\t}\n\t}\n\tselect {\n\tcase m := <-c:\n\t\tgo f(m)\n\t}\nL:\n\tgoto L\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x = []T{{1, 2}, {a: 3}}\nvar y = map[string]int{\"a\": 1,\n}\n"],
    "csharp": ["using System;\nusing static X.Y;\nnamespace A.B;\n[Attr(1, X = 2)]\npublic sealed partial class C<T> : D<T>, IE where T : class, new() {\n  public int P { get; private set; } = 3;\n  public string this[int i] => $\"a{i:N2}{{b}}\";\n  event EventHandler E;\n  public C(int x, params string[] y) : base(x) { }\n  public static C<T> operator +(C<T> a, C<T> b) => a;\n  async Task<int?> F<U>(ref int a, out U b, int c = 1) { b = default; foreach (var (k, v) in d) { if (o is string { Length: > 3 } s and not null) yield return s; } return await x?.y[^1].Z<int>(1) ?? (a, b) switch { (1, _) => 2, _ when c > 3 => throw new X(), _ => 4 }; }\n}\nrecord R(int X, string Y);\nenum E : byte { A = 1, B }\ndelegate void H(int a);\n", "var q = from a in b where a.C > 1 orderby a descending select new { a.D, X = 1 };\nConsole.WriteLine(q);\nint f(int x) => x << 2;\nusing var s = new S { A = 1, [2] = 3 };\nint[] z = [1, ..y];\nvar l = async (int a, int b) => { lock (a) { } };\n#region x\n#endregion\n"],
    "rust": ["#![allow(x)]\nuse a::{b, c::*, d as e};\n#[derive(Debug)]\npub struct S<'a, T: 'a + Clone = i32, const N: usize> where T: Copy { pub x: &'a [T; N], y: Box<dyn Fn(i32) -> T + Send> }\nenum E { A, B(i32, String), C { x: u8 } = 3 }\nimpl<'a, T> Tr for S<'a, T> { const X: u8 = b'a'; type Y = T; async fn f(&mut self, (a, b): (i32, &str)) -> Result<Vec<T>, E> { let v: Vec<_> = a.iter().map(|&x| x as u64 << 2).collect::<Vec<_>>(); match v { Some(1..=3) | None if a => {} E::C { x, .. } => return Err(x)?, _ => (), } if let Some(x) = y && z { loop { break 'o 3; } } else { unsafe { *p = 1 } } for i in 0..10 { println!(\"{}\", i); } S { x: 1, ..d } } }\nmacro_rules! m { ($a:expr) => { $a + 1 }; }\nfn g() -> impl Iterator<Item = u8> { let c = move || r#\"a\"b\"#; 'a'; x.0.1 }\nstatic A: &[&str] = &[\"x\"];\n"],
    "php": ["just text", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\n#[Attr(1)]\nabstract class X extends Y implements Z { use T; const A = 1; private ?int $a = null; public function __construct(private readonly int|string $b = 3, ...$c) { parent::__construct(); } abstract protected static function f(array &$x): ?self; }\nfunction g(int $a, callable $b = null): void { foreach ($a as $k => [$x, $y]) { echo \"a{$k['b']} $x->y\", 'c'; } $f = fn($x) => $x ** 2 ?? match(true) { $a, $b => 1, default => throw new E }; static $q = 1; return; }\n$a = [1, 'b' => 2, ...$c]; list($x, , $y) = $z; $o?->p->{'q'}::R; if ($a): elseif ($b): else: endif; try { } catch (A | B) { } finally { }\n$s = <<<EOT\n a $b\n EOT;\n?>\n<p><?= $x ?></p>\n<?php for ($i = 0; $i < 3; $i++) { ?>x<?php }\n"],
    "kotlin": ["@file:JvmName(\"X\")\npackage a.b\n\nimport c.d.*\n\nsealed class A<out T : B>(val x: Int = 1, private var y: String? = null) : C<T>(x), D by e where T : F {\n    companion object { const val Z = 1 }\n    init { println(\"a${x + 1} $y\") }\n    override val q: Int\n        get() = field * 2\n    fun <R> List<R>.f(a: (Int, String) -> Unit = { _, s -> g(s) }, vararg b: R): R? = when (x) {\n        1, in 2..3 -> null\n        is Int -> b[0]\n        else -> throw E()\n    }\n}\n\ndata class P(val a: Int)\nenum class E(val i: Int) { A(1), B(2) { override fun f() {} }; abstract fun f() }\n\nfun main() {\n    val (a, b) = p\n    var l = list.filter { it > 3 }\n        .map { x -> x * 2 }\n    for (i in 0 until 10 step 2) if (i == 3) continue else l += i\n    val s = \"\"\"raw ${l.joinToString(\"\") { \"x\" }}\"\"\"\n    try { f() } catch (e: X) { } finally { }\n    return\n}\n"],
    "sql": ["WITH a AS (SELECT 1 AS x) SELECT b.*, count(*) FILTER (WHERE y > 1) OVER (PARTITION BY z ORDER BY w DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM a LEFT JOIN b ON a.x = b.x WHERE c IN (1, 2) AND d NOT LIKE 'q%' OR NOT EXISTS (SELECT 1) GROUP BY 1 HAVING sum(e) > 3 ORDER BY 2 NULLS LAST LIMIT 5;\nCREATE TABLE IF NOT EXISTS s.t (id BIGINT PRIMARY KEY, n NUMERIC(12, 2) NOT NULL DEFAULT 0, FOREIGN KEY (n) REFERENCES u (id) ON DELETE CASCADE);\nINSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL) ON CONFLICT DO NOTHING;\nUPDATE t SET a = a + 1, b = CASE WHEN c THEN 1 ELSE 2 END WHERE d BETWEEN 1 AND 2;\nDELETE FROM t;\nALTER TABLE t ADD COLUMN x TEXT, DROP COLUMN y;\nDROP VIEW IF EXISTS v;\n-- end\n"],
}
BROKEN = {
    "python": ["def f(:\n    pass\n", "if a\n    b\n", "x = (1\n", "print 'a'\n", "  x = 1\n y = 2\n", '"""abc\n', "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "# Title\n\nThe text of a page.\n"],
    "javascript": ["function f( { }", "let a = ;", "if (a)) { }", "import logging\nfrom x import y\n", "function f(x: number): string { return x }", "var s = 'abc\n", '{"a": 1, "b": [2]}', "<!DOCTYPE html>\n<p>x</p>\n", "a = {"],
    "typescript": ["const x: = 1", "class A { f( }", "interface A { x: }", "<<<<<<< HEAD\nlet a\n=======\n", "return `a${b"],
    "java": ["class A { int f() { return 1 } }", "class A {", "package a.b\nclass C {}", "class A { void f() { x + 1; } }", "class A { String s = \"a; }", "def f(a):\n    return a\n", "class A { /* open }"],
    "go": ["package a\nfunc f() {\n", "package a\nfunc f() { x := (1 }\n", "func f() {}\n", "package a\nfunc f()\n{\n}\n", "package a\nvar s = \"x\n"],
    "csharp": ["class A { void F( { } }", "class A { int x = ; }", "class A {", "package a.b;\nclass B {}", "class A { void F() { x * y + 1 } }"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "struct S { x: }", "fn f() { (1 + 2 }", "import logging\n"],
    "php": ["<?php\nfunction f( { }", "<?php\n$a = ;", "<?php\nclass A { function }", "<?php\n$s = 'abc;\n", "<?php\nif ($a)) { }"],
    "kotlin": ["fun f( { }", "class A { val x = }", "fun f() { val s = \"a }", "from x import y\n", "fun f() {\n<<<<<<< HEAD\n}\n"],
    "sql": ["SELECT FROM WHERE", "CREATE TABLE t (a INT", "INSERT INTO t VALUES (1,", "import logging\n", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_sources(lang):
    for text in VALID[lang]:
        assert first_error(text, lang) is None, text


@pytest.mark.parametrize("lang", sorted(BROKEN))
def test_broken_sources(lang):
    for text in BROKEN[lang]:
        assert first_error(text, lang) is not None, text


EARLY = {
    "python": ["x = 1 = 2\n", "f() = 3\n", "break\n", "return 1\n", "def f(a, a): pass\n", "def f(a=1, b): pass\n", "def f(**k, a): pass\n", "class A:\n    return 1\n", "for x in y: pass\nelse: break\n", "while x:\n    def f():\n        continue\n", "x + 1 += 2\n",
               "f(a=1, b)\n", "f(x for x in y, 1)\n", "del f()\n", "def f():\n    await g()\n", "yield 1\n", "if x:\n    a\nbreak\n"],
    "javascript": ["const x;", "1 = 2;", "f() = 3;", "let {a};", "1++;", "++f();", "for (f() of x) ;", "a + b = c;"],
    "typescript": ["const x;", "1 = 2;", "let [a];", "f() += 3;"],
    "java": ["class A { void f() { 1 = 2; } }", "class A { void f() { g() = 2; } }", "class A { void f() { 1++; } }"],
}
PLAIN = {
    "python": ["def f(a, *, b=1, c, **k): return\n", "def f(a, /, b=2, *c, d): yield\n", "for x in y:\n    if x: break\n    else: continue\n", "lambda: (yield)\nx = lambda a, a2=1: a\n", "while 1: x = {'a': lambda: 1}; break\n", "async def f():\n    await g()\n    async with a: return [await x async for x in y]\n",
               "a, (b, c), *d = e = f\nx.y[1:2].z = 3\n(x): int = 3\ndel a, (b), [c.d]\nf(*a, b, *c, k=1, *d, **e)\nf(x for x in y)\n", "def f[T](a: T, **k,): return a\n"],
    "javascript": ["[a, b] = [b, a]; ({ a, ...b } = c); (a) = 1; a.b[c]++; --x.y; for (const x of y) ; for (let k in o) ; for (a.b of c) ;", "let a, b = 1; var {c} = d; const e = 1, [f] = g;"],
    "typescript": ["declare const x: number;\ndeclare namespace N { const y: string; }\nlet z!: number; (a as any).b = 1; a!.b = 2; (<any>c) = 3; d! = 4;"],
    "java": ["class A { void f() { a = b = 1; c.d[0] += 2; (e) = 3; i++; --this.j; k[0]--; x = -y++ + ++z; } }"],
}


@pytest.mark.parametrize("lang", sorted(EARLY))
def test_early_errors(lang):
    for text in EARLY[lang]:
        assert first_error(text, lang) is not None, text
    for text in PLAIN[lang]:
        assert first_error(text, lang) is None, text


def test_changed_python_files_are_judged_as_by_the_parser():
    """Files of the standard library with one token dropped, doubled, moved or added."""
    import random
    import warnings

    from quarrylens.llm.syntax import check

    rng, lexer, judged = random.Random(7), check._parser("python")[1], 0
    for path in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:70]:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        at = [t[2] for t in lexer.tokens(text) if t[0][0] not in ("NEWLINE", "INDENT", "DEDENT")]
        if len(text) > 12_000 or len(at) < 5:
            continue
        a, b, c = (lambda k: at[k : k + 3])(rng.randrange(len(at) - 2))
        for changed in (text[:a] + text[b:], text[:b] + text[a:], text[:a] + text[b:c] + " " + text[a:b] + text[c:], text[:a] + rng.choice(["return ", "= ", "( ", "break ", "1 ", "def "]) + text[a:]):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compile(changed, path, "exec")
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            assert (first_error(changed, "python") is None) == valid, changed[max(0, a - 60) : c + 60]
            judged += 1
    assert judged > 60


def test_unknown_languages_and_blanks_are_valid():
    assert first_error("(((", "cobol") is None and first_error(None, "python") is None and first_error(" \n", "go") is None


def test_python_grammar_against_the_parser():
    wrong = 0
    for path in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:60]:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        from quarrylens.llm.syntax import check

        grammar, lexer, newline = check._parser("python")
        wrong += grammar.recognise(lexer.tokens(text), newline) >= 0
    assert wrong == 0


def test_grammars_may_be_ambiguous():
    g = Grammar("start: e\ne: e '+' e | 'x'\n")
    token = lambda s: [((c,), False, i) for i, c in enumerate(s)]
    assert g.recognise(token("x+x+x")) == -1 and g.recognise(token("x++x")) == 2 and g.recognise(token("x+")) == 2


def test_parsing_frames(spark):
    rows = [(1, "r", "./a.py", "python", "h", 1, "x = ("), (2, "r", "b.py", "python", "h", 1, "x = 1"), (1, "r", "a.py", "python", "h", 1, "x = ("), (3, None, None, None, None, None, None), (4, "r", "c.go", "Go", "h", 1, "x" * 100_000)]
    found = spark.createDataFrame(rows, DISCOVERED)
    reports = spark.createDataFrame([("r", ["a.py: syntax error", "b.py: permission denied", "odd"]), ("r", None), (None, ["x: y"])], "repo string, parse_errors array<string>")
    assert sorted(r.file_id for r in parsing.found(messy(found)).collect()) == [1, 4]
    rates = {(r.repo, r.lang): (r.files, r.invalid, r.reported, r.reported_invalid) for r in parsing.parse_rates(found, messy(reports)).collect()}
    assert rates[("r", "python")] == (2, 1, 2, 1)
    assert parsing.found(found.where("false")).count() == 0


NODES = "uid string, kind string, name string, path string, line_start int, line_end int, lang string"
ANSWERS = "answer_id long, symbol string, location string, signature string, documentation string, answered_at timestamp"
JAVA = 'class A {\n    /**\n     * Posts the order } once.\n     */\n    public long post(long a, String b) {\n        log.info("}} {");\n        if (a > 1) { return 2; } // }\n        return 1;\n    }\n}\n'
PYTHON = 'import x\n\n@dec\ndef post_order(a,\n               b=(1, 2)):\n    """Doc."""\n    if a:\n        return "x:"\n\n    return b\n\ny = 1\n'


def test_captured_functions():
    comment, signature, body = pairs.capture(JAVA, "java", 5)
    assert comment.startswith("/**") and signature == "public long post(long a, String b)" and body.endswith("return 1;\n    }")
    comment, signature, body = pairs.capture(PYTHON, "python", 4)
    assert comment == "@dec" and signature.startswith("def post_order(a,") and body.rstrip().endswith("return b")
    assert pairs.capture(JAVA, "java", 99) is None and pairs.capture(JAVA[:140], "java", 5) is None


def test_capture_keeps_to_the_lines_of_the_function():
    text = "fun f(a: Int) = a + 1\n\nfun g(x: (Int) -> Unit) {\n    x(1)\n}\n\n/** Declared. */\nabstract fun h(a: Int);\n"
    assert pairs.capture(text, "kotlin", 1, 1) == ("", "fun f(a: Int) = a + 1", "")
    assert pairs.capture(text, "kotlin", 3, 5)[2] == "{\n    x(1)\n}"
    assert pairs.capture(text, "kotlin", 8) == ("/** Declared. */", "abstract fun h(a: Int)", ";")
    rust = "fn pick<'a>(x: &'a [u8; 4], y: &'a str) -> [u8; 2] {\n    [x[0], b'{']\n}\n"
    assert pairs.capture(rust, "rust", 1, 3)[1] == "fn pick<'a>(x: &'a [u8; 4], y: &'a str) -> [u8; 2]"


def test_captures_cost_what_they_read():
    import time

    def took(n):
        source = pairs.Source("class A {\n" + "".join(f"    int f{k}(int a) {{\n        return g(a, (({k})));\n    }}\n" for k in range(n)) + "(" * 2000)
        start = time.process_time()
        assert all(pairs.capture(source, "java", 2 + 3 * k, 4 + 3 * k) for k in range(n))
        return time.process_time() - start

    took(100)
    assert took(4000) < 20 * max(took(500), 0.01)


TRIVIAL = ["", None, "/** */", "TODO: document", "Copyright (c) 2021 Norvik Works. All rights reserved.", "@param a the first of all values\n@return the result of it", ":param a: the first of all values", "post_order() method", "This function posts order.", "Posts the order",
           "noqa: E501 this line is much too long", "eslint-disable-next-line no-unused-vars no-undef no-console max-len", "a = reserve(a, 9);\nreturn a;", "if (a > 1) {\n  return b;\n}", "Description of the function goes here", "----------------", "Auto-generated method stub", "todo write documentation for this one when ready", "{@inheritDoc}", "Created by the editor template, replace this text."]
TELLING = ["Only weekdays count; holidays shift forward.", "/**\n * <p>Runs inside one transaction, otherwise raises.</p>\n * @param a the value\n */", "Posts the order. Rounds half to even because auditors demand it.\nTODO: cover the rounding case", "Đơn hàng được khóa sau khi hạch toán xong.", "รายการราคาต้องตรวจสอบจำนวนเงินเมื่อสินค้ามาถึงคลังกลาง"]


def test_documentation_that_says_something():
    assert [t for t in TRIVIAL if pairs.telling_words(t, "post_order") >= pairs.MIN_WORDS] == []
    assert [t for t in TELLING if pairs.telling_words(t, "post_order") < pairs.MIN_WORDS] == []


def test_pairs_of_functions(spark):
    from datetime import datetime

    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    good = TELLING[0]
    nodes = spark.createDataFrame([("u1", "Symbol", "post", "A.java", 5, 9, "java"), ("u1", "Symbol", "post", "A.java", 5, 9, "java"), ("u2", "Symbol", "A", "A.java", 1, 10, "java"), ("u3", "Symbol", "gone", "no.java", 3, 4, "java"), ("u4", "Symbol", "x", None, 1, 2, None), ("f", "File", "A.java", "A.java", 0, 10, "java"), ("u5", "Symbol", "post_order", "b.py", 4, 10, "python"), (None, "Symbol", "q", "A.java", 7, 8, "java")], NODES)
    answers = spark.createDataFrame([
        (1, "u1", "A.java:5", "public long post(long a, String b)", "TODO", t1), (2, None, "A.java:5", "public long post(long a,\n  String b)", good, t2), (3, "u2", "A.java:1", "class A", good, t1), (4, "u3", "no.java:3", "void gone()", good, t1),
        (5, "u5", "b.py:4", "def post_order(a, b)", good, t1), (6, "u5", None, "def post_order(a, b)", None, t2), (7, None, None, "void f()", good, t1), (8, "u5", "b.py:4", None, good, None)], ANSWERS)
    found = spark.createDataFrame([(1, "r", "./A.java", "java", "h", 1, JAVA.replace("\n", "\r\n")), (2, "r", "b.py", "python", "h", 1, PYTHON), (3, "r", None, None, None, None, None)], DISCOVERED)
    rows = {r.uid: r for r in pairs.function_pairs(messy(nodes), messy(answers), messy(found)).collect()}
    assert set(rows) == {"u1", "u3"}
    assert rows["u1"].code.startswith("public long post") and rows["u1"].comment.startswith("/**") and rows["u3"].code is None
    assert pairs.found(nodes.where("false"), answers, found).count() == 0 and pairs.found(nodes, answers.where("false"), found).count() == 0
