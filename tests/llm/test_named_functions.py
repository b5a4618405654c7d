from linkloom.parse.source import functions

from test_docpairs import pairs_of

def named(language, text):
    return [f[0] for f in functions(language, text)]


def test_braces_in_parameter_lists():
    assert named("javascript", "function draw({ width, height }) { }\nclass A { load(options = {}) { } }\nconst g = ({ a }) => { };\nconst o = { h(x = { y: 1 }) { } };") == ["draw", "load", "g", "h"]
    assert named("java", 'class A { void f(@A({"x"}) int a) { } @B({\n"y"\n}) int g() { return 1; } }') == ["f", "g"]
    assert named("cpp", "void f(Opt o = {}) { }\nint g(int x = int{3}) noexcept { return x; }") == ["f", "g"]


def test_named_functions_inside_others():
    js = """(function () {
  /** Winds the rope. */
  function wind() { function inner() { } const none = function () { }; }
  const spin = function () { };
  exports.turn = (a) => { };
})();
define(["x"], function (x) { function load() { } const keep = () => { }; });
const deep = { a: { b: { ring() { }, toll: function () { } } } };
function make() { return { open() { }, shut: () => { } }; }
list.forEach(function (x) { const gone = function () { }; });
"""
    assert named("javascript", js) == ["wind", "inner", "spin", "turn", "load", "keep", "ring", "toll", "make", "open", "shut"]
    assert named("cpp", "int f() { struct L { int g() { return 1; } }; if (x) { call(y); } return 2; }") == ["f", "g"]
    java = "class A { void f() { new Thread(new Runnable() { public void run() { } }).start(); } A() { if (x) { g(y); } } }\nenum E { X, Y(1) { int h() { return 1; } }, Z { int k() { return 2; } }; E() { } abstract int h(); }"
    assert sorted(named("java", java)) == ["f", "h", "k", "run"]


def test_comments_of_newly_found_functions():
    js = b"define(function () {\n    go({ a: 1 })\n    /** Winds the rope twice. */\n    function turn({ a }) { }\n});\n"
    assert [(r[0], r[1]) for r in pairs_of("r/a.js", js)] == [("turn", 4)]
    java = b'class A {\n    /** Winds the rope twice. */\n    @B({\n        "x"\n    })\n    void turn(@C({"y"}) int a) { }\n}\n'
    assert [(r[0], r[1]) for r in pairs_of("r/A.java", java)] == [("turn", 6)]
