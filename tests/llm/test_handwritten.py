from linkloom.llm import handwritten as H

HAND = "package a;\n\n/* helpers */\npublic class Tide {\n" + "".join(f"    int turn{w}(int a) {{\n        {b}\n    }}\n" for w, b in zip(("Low", "High", "Slack", "Ebb"), ("if (a > 2) return walk(a, 1);", "for (int i = 0; i < a; i++) log(i + \"x\");", "try { sail(); } catch (Gale e) { furl(e); } return 0;", "return a == 3 ? drift(a) : a * 7 - deck.size();"))) + "}\n"
TABLE = "public final class T {\n" + "".join(f"    public int action{i}(int s) {{\n        switch (s) {{\n            case {i}: return {i * 7};\n        }}\n        return -1;\n    }}\n" for i in range(12)) + "}\n"
MIN = "!function(e){var t={};function n(r){if(t[r])return t[r].x;var o=t[r]={i:r,l:!1,x:{}};return e[r].call(o.x,o,o.x,n),o.l=!0,o.x}" * 20
DATA = "const unsigned char k[] = {\n" + ",\n".join("0x1f, 0x22, 0x9a, 0x07" for _ in range(30)) + "\n};\n"


def judged(spark, rows, packages=("quillbox",)):
    files = spark.createDataFrame([(p, (c.encode() if isinstance(c, str) else c), r) for p, c, r in rows], "path string, content binary, repo string")
    out = H.judged(files, spark.createDataFrame([(p,) for p in packages], "package_name string")).collect()
    return {r["path"]: {k for k in ("generated", "minified", "vendored", "data") if r[k]} for r in out}


def test_kinds_and_decoys(spark):
    copy = HAND.replace("Tide", "Wave")
    rows = [
        ("r/src/Tide.java", HAND, "r"), ("r/src/Tide.java", HAND, "r"), ("r/generated/Own.java", "// Copyright (c) 2020 the owners of this repository.\n" + HAND.replace("Tide", "Own"), "r"),
        ("r/src/Stub.java", HAND.replace("Tide", "Stub").replace("/* helpers */", "/* Auto-generated method stub */"), "r"),
        ("r/src/Talk.java", HAND.replace("Tide", "Talk").replace("return 0;", "return 0; // Code generated by x. DO NOT EDIT.") + "// the header says @generated; we strip it\n", "r"),
        ("r/src/Gen.java", "// Code generated by wire. DO NOT EDIT.\n" + HAND.replace("Tide", "Gen"), "r"), ("r/src/Tail.java", HAND.replace("Tide", "Tail") + "// <auto-generated>\n", "r"), ("r/src/T.java", TABLE, "r"),
        ("r/src/m.js", MIN, "r"), ("r/src/k.h", DATA, "r"), ("r/src/Lic.java", "/*\n * Quillbox Authors\n * SPDX-License-Identifier: MIT\n */\n" + HAND.replace("Tide", "Lic"), "r"),
        ("r/src/Bang.java", "/*! tide v2.1.0 | (c) The Harbor Crew | MIT */\n" + HAND.replace("Tide", "Bang"), "r"),
        ("r/third/quillbox-2.1.0/In.java", HAND.replace("Tide", "In"), "r"), ("r/third/party/Out.java", HAND.replace("Tide", "Out"), "r"), ("r/src/Wave.java", copy, "r"), ("q/src/Wave.java", "// moved\n" + copy, "q"),
        ("r/e.js", b"", "r"), ("r/n.js", None, None), (None, MIN, "r"),
    ]
    rows += [(f"r/src/House{i}.java", "// Copyright (c) 2020 the owners of this repository.\n" + HAND.replace("Tide", f"House{'ABCD'[i]}"), "r") for i in range(4)]
    got = judged(spark, rows)
    hand = {f"r/src/House{i}.java" for i in range(4)} | {"r/src/Tide.java", "r/generated/Own.java", "r/src/Stub.java", "r/src/Talk.java", "r/third/party/Out.java", "r/e.js", "r/n.js"}
    assert {p for p, k in got.items() if not k} == hand
    assert {p for p, k in got.items() if "generated" in k} == {"r/src/Gen.java", "r/src/Tail.java", "r/src/T.java"}
    assert got["r/src/Bang.java"] == {"vendored"}
    assert got["r/src/k.h"] == {"data"} and got["r/src/Lic.java"] == {"vendored"} and got["r/third/quillbox-2.1.0/In.java"] == {"vendored"}
    assert got["r/src/Wave.java"] == got["q/src/Wave.java"] == {"vendored"}


def test_mangled_names_surprise_the_model(spark):
    rows = [(f"r/H{i}.java", HAND.replace("Tide", f"Tide{i}"), "r") for i in range(30)] + [("r/m.js", MIN, "r")] + [(f"r/h{i}.js", f"function reduceLedger{'abcdefgh'[i]}(page) {{\n    return page.bind(store);\n}}\n", "r") for i in range(8)]
    files = spark.createDataFrame([(p, c.encode(), r) for p, c, r in rows], "path string, content binary, repo string")
    got = {r["path"]: r["surprise"] for r in H.score(H.features(files)).collect()}
    assert got["r/m.js"] > max(v for p, v in got.items() if p != "r/m.js")
    assert H.judged(files.limit(0), spark.createDataFrame([], "package_name string")).count() == 0


def test_very_long_file_and_trigrams(spark):
    assert judged(spark, [("r/long.js", "let a = b;\n" * 50_000, "r")])["r/long.js"] is not None


def test_a_foreign_naming_style_is_vendored(spark):
    snake = "class Deep {\npublic:\n" + "".join(f"    int {a}_{b}(int old_{a});\n" for a in ("wet", "dry", "calm") for b in ("rope", "sail", "tide")) + "};\n"
    camel = "class Deep{0} {{\npublic:\n" + "".join(f"    int {a}{b}{{0}}(int old{b});\n" for a in ("wet", "dry", "calm") for b in ("Rope", "Sail", "Tide")) + "}};\n"
    got = judged(spark, [("r/a.hpp", snake, "r")] + [(f"r/c{i}.hpp", camel.format("ABCDEFGH"[i]), "r") for i in range(8)])
    assert got["r/a.hpp"] == {"vendored"} and not any(got[f"r/c{i}.hpp"] for i in range(8))


def test_trigram_edges():
    keys, _ = H._trigrams({"a"})
    assert keys == sorted(keys) and all(0 <= k < 1 << 15 for k in keys)
