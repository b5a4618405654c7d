import pytest

from linkloom.llm import syntax as S

JAVA_OK = [
    "", "// only a comment", "package a.b;\nimport java.util.*;\nimport static java.lang.Math.max;\n@A(x = \"}\") public class B<T extends C & D> extends E implements F {\n  int[] t = {1, -2,};\n  @Deprecated\n  public <K> Map<K, List<? super T>> m(final int a, String... r) throws X {\n    for (int i = 0; i < 3; i++) { if (a > 1) return null; else x(); }\n    Runnable q = () -> { y('}'); };\n    String s = \"\"\"\n      } <<<<<<<\n      \"\"\";\n    int z = (int) w + -v;\n    return switch (a) { case 1 -> 2; default -> throw new E(); };\n  }\n}\n",
    "/*\n<<<<<<< a { =======\n*/\ninterface I { default void f() { } int g(); }\nenum K { A, B(1) { void h() { } }; K(int... x) { } }\nrecord R(int a) { }\n",
]
JAVA_BAD = [
    "class A { void f() { ", "class A { void f() { } } }", "class A { void f() { g(1 } }", "class A { String s = \"x; }", "class A { void f() {\n<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n} }",
    "class A { void f() { int a = 1 int b = 2; } }", "class A { void f() { g(1) h(2); } }", "import os\n\ndef f(x):\n    return x\n", "<?xml version=\"1.0\"?>\n<a/>\n", "class A {\n... (12 lines omitted)\n}", "#include <x>\nint f() { return 1; }",
    "class A { void f() { x = ; } }", "class A { void f() { log(“x”); } }", "class A { /* open", "class A { }\u0000", "SELECT * FROM t;", "class A { void f() { return 1 } }",
]
CPP_OK = [
    "", "#pragma once\n#include <a>\nnamespace n::m {\ntemplate <typename T, int N = 3>\nclass A : public B<T>, private C {\npublic:\n  A() : x{1}, y(2) {}\n  virtual ~A() = default;\n  int f(int a, const char* b = \"}\") const noexcept override;\n  bool operator==(const A& o) const { return x == o.x; }\nprivate:\n  int x{}, y;\n};\n}  // namespace\n",
    "int f() {\n#ifdef NOT_HERE\n  if (a > 1) {\n#else\n  if (a > 2) {\n#endif\n    return 1;\n  }\n  auto g = [&](int q) { return q; };\n  const char* s = R\"x({[()x\";\n  std::vector<std::map<int, int>> v{{1, 2}};\n  for (auto& [k, w] : v) k++;\n  return a ? -1 : +2;\n}\n",
    "#if 0\n<<<<<<< broken {{{ \"\n#endif\nint a = 1'000;\nenum class E : int { A = 1, B };\nstatic const int t[] = {1, 2, -3};\nextern \"C\" { void f(); }\n",
]
CPP_BAD = [
    "int f() { return 1;", "int f() { return 1; } }", "#if X\nint a;\n", "#endif\n", "class A { int x; }\nint f();", "int f() { g(1) h(2); }", "public class A { }", "package com.x;\n\npublic class A { }", "int f() {\n#ifdef A\n  x(;\n#else\n  y(;\n#endif\n}",
    "int a = 1\nint b = 2;", "int f() { const char* s = \"x; }", "import os\n\ndef f(x):\n    print(x)\n", "CREATE TABLE a (\n b INTEGER\n);", "@@ -1,2 +1,3 @@\n-int a;\n+int b;\n", "#!/bin/sh\necho 1\n",
]
JS_OK = [
    "", "#!/usr/bin/env node\n'use strict'\nlet a = 1\nconst b = [1, , 2].map((x) => x * 2)\nfoo()\nvar r = /[/\"'}]/g.test(s), q = a / b / c\nlabel: for (const k of xs) { if (k) continue label }\n",
    "import d, { e as f } from 'x';\nimport * as g from \"y\";\nexport default class A extends B {\n  #p = 1;\n  static async *m({ a, b = 2 }, ...c) { yield* this.#p; await z; }\n  get v() { return `${a + `${b}`} } <<<<<<<`; }\n  constructor() { super(); }\n}\nexport const h = async (x) => { try { y() } catch { } finally { } };\nmodule.exports = { a, b: 1, 'c': 2, [d]: 3, e() { }, get f() { return 1 } };\n",
    "const help = `\n=======\n }\n`;\nif (a) b(); else c()\ndo x++; while (x < 3)\nx = a ?? b?.c?.[d];\nlet n = 1_000n + .5e3\nreturn_ = {return: 1, if: 2}.if\n(function () { })()\n",
]
JS_BAD = [
    "function f() {", "f(1}", "let a = ;", "let s = 'x\nlet b = 1", "const a = `x", "int base = 3;\n", "package com.x;", "#include <a>\nint f() { }", "{\n \"a\": 1,\n \"b\": {}\n}", "<!doctype html>\n<html></html>", "def f(x):\n  return x\n",
    "function f() {\n  ... (12 lines omitted)\n}", "a = 1 b = 2", "<<<<<<< a\nx()\n=======\ny()\n>>>>>>> b\n", "let x = “a”", "if x { }", "f(,)", "let a = [1, 2", "SELECT * FROM a WHERE b",
]


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in (("java", JAVA_OK), ("cpp", CPP_OK), ("javascript", JS_OK)) for t in ts])
def test_valid(language, text):
    assert S.faults(language, text) == []


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in (("java", JAVA_BAD), ("cpp", CPP_BAD), ("javascript", JS_BAD)) for t in ts])
def test_invalid(language, text):
    assert S.faults(language, text)


def test_every_cut_of_a_valid_file_is_found_or_still_valid():
    text = JAVA_OK[1]
    for at in range(60, len(text) - 2):
        assert S.faults("java", text[:at]), text[max(0, at - 20) : at]


def test_table_with_nulls_repeats_and_long_texts(spark):
    long = b"class A {\n" + b"  int f() { return g(1, '}'); }\n" * 20_000 + b"}\n"
    rows = [("r/a.java", b"class A { }", "r"), ("r/a.java", b"class A { }", "r"), ("r/b.java", b"class A {", None), ("r/b.java", b"class A {", None), ("r/c.h", None, "r"), ("r/d.txt", b"(", "r"), (None, b"(", "r"), ("r/e.java", long, "r"), ("r/u.js", "let ü = 'é'".encode("utf-16"), "r")]
    files = spark.createDataFrame(rows, "path string, content binary, repo string").selectExpr("*", "1 as fault", "'x' as language")
    assert [r["path"] for r in S.unparsable(files).collect()] == ["r/b.java"]
    rates = {(r["repo"], r["language"]): (r["files"], r["faulty"], r["share"]) for r in S.fault_rates(files).collect()}
    assert rates[("r", "java")] == (2, 0, 0.0) and rates[(None, "java")] == (1, 1, 1.0)
    assert S.unparsable(files.limit(0)).count() == 0 and S.fault_rates(files.limit(0)).count() == 0
