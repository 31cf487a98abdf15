"""Cases written by hand after the rules were, none of them in the test tables."""

import pytest

from quarrylens.llm import provenance
from quarrylens.llm.syntax.check import first_error

PY = "import os\n\n\ndef total(rows):\n    return sum(r.amount for r in rows)\n"
JS = "export function total(rows) {\n  return rows.reduce((a, r) => a + r.amount, 0);\n}\n"
GO = "package billing\n\nfunc Total(a, b int) int {\n\treturn a + b\n}\n"
#: (path, language, content, whether nobody of the repository wrote it)
ORIGINS = [
    ("frontend/node_modules/left-pad/index.js", "javascript", JS, True),
    ("src/third_party/abseil/strings.py", "python", PY, True),
    ("static/vendor/bootstrap/js/tooltip.js", "javascript", JS, True),
    ("assets/vendor/chartjs-3.9.1/chart.js", "javascript", JS, True),
    ("native/extern/glfw/window.c", "java", "class A { int x = 1; }\n", True),
    ("tools/external/sqlite3/shell.py", "python", PY, True),
    ("lib/python3.11/site-packages/six.py", "python", PY, True),
    ("vendor/github.com/pkg/errors/stack.go", "go", GO, True),
    ("Pods/Alamofire/Source/Session.kt", "kotlin", "fun total(a: Int): Int = a + 1\n", True),
    ("api/orders.pb.go", "go", GO, True),
    ("api/orders_pb2.py", "python", PY, True),
    ("Forms/Order.Designer.cs", "csharp", "class A { int x = 1; }\n", True),
    ("db/models.py", "python", "# This is an auto-generated Django model module.\n# This file is generated by inspectdb.\n" + PY, True),
    ("rpc/stub.go", "go", "// Code generated by mockgen. DO NOT EDIT.\n// Source: store.go\n\n" + GO, True),
    ("src/Lexer.java", "java", "// Generated automatically from Lexer.g4, do not modify.\nclass Lexer { int s = 0; }\n", True),
    ("web/dist/app.min.js", "javascript", "var a=1;", True),
    ("web/app.bundle.js", "javascript", JS, True),
    ("js/all.js", "javascript", "".join(f"var a{i}=function(b,c){{return b?c+{i}:b*{i}}},d{i}=a{i}(1,2);" for i in range(30)), True),
    ("geo/points.py", "python", "POINTS = [\n" + "".join(f"    ({i * 0.37:.3f}, {i * 1.91:.3f}, {i}),\n" for i in range(80)) + "]\n", True),
    ("data/blob.js", "javascript", 'export default [' + ",".join(f'"aGVsbG8{i}d29ybGQ{i}"' for i in range(60)) + "];\n", True),
    ("src/wrapper.ts", "typescript", "/* tslint:disable */\n/**\n * This file was automatically generated by json-schema-to-typescript.\n * DO NOT MODIFY IT BY HAND.\n */\n\nexport interface A { b: string }\n", True),
    ("app/vendor/views.py", "python", PY, False),
    ("app/vendors/models.py", "python", PY, False),
    ("external/client.py", "python", PY, False),
    ("deps/graph.py", "python", PY, False),
    ("src/deps/resolve/order.py", "python", PY, False),
    ("billing/external/rates.py", "python", PY, False),
    ("app/generated_reports.py", "python", '"""Reports that were generated last night are mailed here."""\n' + PY, False),
    ("src/min/max.js", "javascript", JS, False),
    ("src/admin.js", "javascript", JS, False),
    ("app/edit.py", "python", "# Users do not edit closed orders; see the permission table.\n" + PY, False),
    ("app/prices.py", "python", "# Do not modify prices after posting.\n" + PY, False),
    ("app/codegen.py", "python", 'HEADER = "// Code generated by our templates. DO NOT EDIT."\n' + PY, False),
    ("app/legacy.py", "python", "# This module was once generated; we maintain it by hand since 2019.\n" + PY, False),
    ("app/license.py", "python", "# Copyright (c) 2021 Norvik Works. All rights reserved.\n" + PY, False),
    ("app/limits.py", "python", "LIMITS = {'small': 10, 'medium': 50, 'large': 100}\n" + PY, False),
    ("app/routes.py", "python", "".join(f"@route('/{n}')\ndef {n}(request):\n    return render(request, '{n}.html', load_{n}(request))\n\n" for n in ("orders", "items", "stock", "users")), False),
    ("src/Bundle.java", "java", "class Bundle { String pack(String a) { return a.trim(); } }\n", False),
    ("lib/lockfile.py", "python", PY, False),
    ("src/proto/reader.go", "go", GO, False),
]
#: (language, source, whether it is valid)
SYNTAX = [
    ("python", "class A:\n    x: int = 1\n    def f(self):\n        return f'{self.x!r:>{10}}'\n", True), ("python", "try:\n    pass\nexcept A, B:\n    pass\n", False), ("python", "exec 'x'\n", False),
    ("python", "def f(:\n    pass\n", False), ("python", "x = [1, 2\ny = 3\n", False), ("python", "if x:\n    y\n   z\n", False), ("python", "match a:\n    case [x, *_] if x > 1: pass\n", True),
    ("javascript", "const {a, ...b} = c; for await (const x of y) { }", True), ("javascript", "let x = 1;\nlet = 2;", False), ("javascript", "if (a) { b() ", False), ("javascript", "const f = (a, b => a;", False),
    ("javascript", "class A { get x() { return 1 } static #y = 2 }", True), ("javascript", "a ? b c;", False), ("javascript", "return { a: 1, b: };", False), ("javascript", "var a = `x${b`;", False),
    ("typescript", "function f<T extends keyof U>(a: T, b?: U[T]): asserts a is T { }", True), ("typescript", "interface A { b: string; c(d: number): void }", True), ("typescript", "type A = { b: ;", False),
    ("typescript", "enum A { B = 1, C", False), ("typescript", "let a: Array<string = [];", False),
    ("java", "public record P(int x, int y) { static int z; }", True), ("java", "class A { void f() { int x = 1 } }", False), ("java", "class A { void f( { } }", False), ("java", "class A { int f() { return a +; } }", False),
    ("java", "import a.b\nclass A { }", False), ("java", "class A { List<String> x = new ArrayList<>(); }", True), ("java", "class A { void f() { if (x { } } }", False),
    ("go", "package a\n\nfunc f[T any](x T) (T, error) { return x, nil }\n", True), ("go", "package a\n\nfunc f() { if x { }\n", False), ("go", "package a\n\nvar x int = \n", False), ("go", "package a\n\nfunc f(a int b int) {}\n", False),
    ("csharp", "class A { public int X { get; init; } = 3; }", True), ("csharp", "class A { void F() { var x = ; } }", False), ("csharp", "class A { void F() { foo( } }", False), ("csharp", "namespace A { class B { }", False),
    ("rust", "fn f<'a>(x: &'a str) -> Option<&'a str> { x.split(' ').next() }", True), ("rust", "fn f() { let x = 1 let y = 2; }", False), ("rust", "struct A { x: i32 y: i32 }", False), ("rust", "fn f() -> { 1 }", False),
    ("php", "<?php\nfunction f(?int $a = null): ?string { return $a?->b ?? 'x'; }\n", True), ("php", "<?php\nfunction f( { }\n", False), ("php", "<?php\n$a = [1, 2;\n", False), ("php", "<?php\nclass A { public $b = ; }\n", False),
    ("kotlin", "data class A(val x: Int) { fun f() = x.let { it + 1 } }\n", True), ("kotlin", "fun f(a Int) { }\n", False), ("kotlin", "fun f() { val x = (1 + 2 }\n", False), ("kotlin", "class A { fun }\n", False),
    ("sql", "SELECT a, COUNT(*) FROM t JOIN u USING (id) GROUP BY a HAVING COUNT(*) > 1;", True), ("sql", "SELECT a FROM t WHERE (b = 1;", False), ("sql", "CREATE TABLE t (a INT,, b INT);", False), ("sql", "UPDATE t SET WHERE a = 1;", False),
]


def rates(pairs):
    hit = sum(a and b for a, b in pairs)
    return hit / max(1, sum(a for a, _ in pairs)), hit / max(1, sum(b for _, b in pairs))


def test_origins():
    pairs = [(provenance.judge(p, g, c) is not None, case) for p, g, c, case in ORIGINS]
    precision, recall = rates(pairs)
    assert precision >= 0.9 and recall >= 0.9, [(x[0], a) for x, (a, b) in zip(ORIGINS, pairs) if a != b]


@pytest.mark.parametrize("lang", sorted({x[0] for x in SYNTAX}))
def test_syntax(lang):
    wrong = [t for g, t, valid in SYNTAX if g == lang and (first_error(t, g) is None) != valid]
    assert not wrong
