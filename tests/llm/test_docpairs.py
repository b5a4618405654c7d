from linkloom.llm import docpairs as D, scan, syntax
from linkloom.parse import lexer as L

JAVA = b'''package a.b;

class Outer {
    private int batch = 4; // Trailing words about the field.
    void after() { }

    /** Builds the outer thing. */
    Outer(int x) { }

    /**
     * Moves each record into the vault before midnight.
     * @param x
     */
    @Tag("}")
    public static <T> int
    move(int x, String y) { return 1; }

    // Not adjacent to anything below.

    void lonely() { }

    /* int old = 5; */
    void disabled() { }

    // ------------------
    void separated() { }

    /** TODO: write docs */
    void todo() { }

    /** Load beacon matrix. @return the matrix */
    void loadBeaconMatrix() { Runnable r = () -> { x(); }; }

    /** @param x how far the crane may swing */
    abstract int noBody(int x);

    /** @param x how far the crane may swing */
    void tagged(int x) { }

    // First line of an explanation that goes on,
    // and ends here.
    void lines() { }

    class Inner {
        /* \xc3\x9cbertr\xc3\xa4gt jedes Journal der Reihe nach. */
        void german() { }
    }
}
'''
CPP = b'''namespace n {
class A {
public:
    /// Decides whether a tide may turn.
    template <typename T>
    [[nodiscard]]
    int decide(int a) const { return a; }
    /// Only declared, never defined here.
    int declared(int a);
    //! Makes it.
    A() : x(1) {}
};
/* \xe6\x8c\x89\xe5\x88\xb0\xe8\xbe\xbe\xe9\xa1\xba\xe5\xba\x8f\xe5\xa4\x84\xe7\x90\x86\xe6\xaf\x8f\xe4\xb8\x80\xe4\xb8\xaa */
void
B::chinese(int q)
{
    auto f = [&](int z) { return z; };
}
}
'''
JS = b'''// Copyright (c) 2020 the owners of this repository.
export async function first(a) { }
/** Walks the fence twice. */
const second = (a, b) => {
    /** Inner words that count for nothing. */
    const inner = function () { };
};
class C {
    // Rings the bell until noon.
    static async *ring(x) { if (x) { return 1; } }
    /** Sets the thing up. */
    constructor() { }
}
/** Keeps the ledger dry. */
exports.third = function (x) { };
'''


def pairs_of(path, content):
    unit = L.Unit(L.language_of(path), L.decode(content))
    return [] if syntax.faults(unit.language, unit.text, unit) else D.found(unit)


def found(path, content):
    return {(r[0], r[1]) for r in pairs_of(path, content)}


def test_java():
    assert found("r/A.java", JAVA) == {("move", 16), ("tagged", 38), ("lines", 42), ("german", 46)}


def test_cpp():
    assert found("r/a.hpp", CPP) == {("decide", 7), ("chinese", 15)}


def test_javascript():
    assert found("r/a.mjs", JS) == {("second", 4), ("ring", 10), ("third", 15)}


def test_crlf_and_bodies():
    row = [r for r in pairs_of("r/A.java", JAVA.replace(b"\n", b"\r\n")) if r[0] == "move"][0]
    assert row[1] == 16 and row[4] == "Moves each record into the vault before midnight." and row[5].rstrip().endswith("return 1; }")


def test_documentation_or_not():
    yes = lambda c, n="readLedger", s="int readLedger(int page)": D.is_documentation(c, n, s)
    assert yes("/** Reads a ledger without waiting for the clerk. */") and yes("/** @return the worn page */") and yes("// Sucht das nächste offene Konto")
    for c in ("/** */", "//", "// readLedger", "/** Reads the ledger. */", "/* This function reads ledger page. */", "/** @param page\n * @return */", "// N/A", "/* ... */", "/// see above", "/** {@inheritDoc} */", "// =====", "/*\n * if (page > 6) {\n *     build(page);\n * }\n */", "// Auto-generated method stub", "// TODO"):
        assert not yes(c), c


def test_tables(spark):
    rows = [("r/A.java", JAVA), ("r/A.java", JAVA), ("r/bad.java", b"class A { /** Words that matter. */ void f() {"), ("r/a.mjs", JS), (None, JS), ("r/n.java", None), ("r/e.js", b""), ("r/x.txt", JS)]
    files = spark.createDataFrame(rows, "path string, content binary").selectExpr("*", "'x' as func_name", "'r' as repo")
    out = spark.createDataFrame([("r/a.mjs",)], "path string")
    got = D.pairs(scan.scan(files), out).collect()
    assert {(r["path"], r["func_name"]) for r in got} == {("r/A.java", n) for n in ("move", "tagged", "lines", "german")} and len(got) == 4
    assert D.pairs(scan.scan(files.limit(0)), out).count() == 0
