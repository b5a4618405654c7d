import json

from pyspark.sql import functions as F

from linkloom import __main__ as cli, providers
from linkloom.parse import facts, lexer
from linkloom.plans import build as B
from linkloom.sources import sinks, tree
from linkloom.streaming import incremental

FILES = {
    "p/src/a/Door.java": "package a.b;\nimport java.util.List;\nimport static x.Y.z;\n/** Opens doors. */\npublic class Door {\n  // Turns the key.\n  public int turn(final String key, int[] n) { hinge(); return lock.spin(key); }\n  public int turn(String key) { return 1; }\n  Door() { }\n  void hinge() { new Door(); if (x) { turn(1); } }\n  static class Bell { void ring() { hinge(); } }\n}\n",
    "p/src/m.mjs": "import d, { e } from './x';\nconst r = require('y');\nexport function walk(a, b = 2) { run(); helper.turn(); }\nclass Gate { async open(x) { walk(x); } }\nexport { walk as w, Gate };\n// import q from 'none';\n",
    "p/src/t.cpp": "#include <map>\n#include \"own.h\"\nnamespace n {\nint total;\nstatic const int kMax = 3;\nclass Tank {\npublic:\n  Tank() {}\n  int level() const;\n  void fill(const char* what, int by) { total = total + by; level(); }\n};\nint Tank::level() const { return total; }\nint drain(int x) {\n#if 0\n  broken(((\n#endif\n  return Tank::level(x);\n}\n}\n",
    "p/lib/skip.java": "class Skip { }",
    "p/src/none.py": "x = 1",
}


def frame(spark):
    return spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")


def test_languages_and_encodings():
    assert lexer.decode("ü".encode("latin-1") + b" ") == "ü " and lexer.decode("按".encode("gbk")) == "按" and lexer.decode(b"\xef\xbb\xbfx") == "x" and lexer.decode(None) == ""
    assert lexer.language_of("a/b.MIN.JS") == "javascript" and lexer.language_of("a.b/c") is None and lexer.language_of(None) is None


def test_facts_of_each_language():
    rows = {p: facts.extract(p, t.encode()) for p, t in FILES.items()}
    ids = {r["id"] for rs in rows.values() for r in rs if r["kind"] == "node"}
    assert {"Class:a.b.Door", "Class:a.b.Door.Bell", "Method:a.b.Door.turn", "Method:a.b.Door.hinge", "Method:a.b.Door.Bell.ring", "Param:Method:a.b.Door.turn.key", "Return:Method:a.b.Door.turn", "Function:m.walk", "Method:m.Gate.open", "Class:m.Gate",
            "Class:n::Tank", "Method:n::Tank::level", "Method:n::Tank::fill", "Function:n::drain", "GlobalVar:p/src/t.cpp:total", "GlobalVar:p/src/t.cpp:kMax"} <= ids
    assert "Method:a.b.Door.Door" not in ids and not rows["p/src/none.py"]
    java = [r for r in rows["p/src/a/Door.java"] if r.get("id") == "Method:a.b.Door.turn" and r["kind"] == "node"]
    assert len(java) == 1 and (java[0]["data_type"], java[0]["start_line"], java[0]["comment"]) == ("int", 7, "Turns the key.")
    assert [(r["name"], r["data_type"], r["position"]) for r in rows["p/src/a/Door.java"] if r.get("type") == "Parameter"] == [("key", "String", 0), ("n", "int[]", 1)]
    edges = {(r["source_id"], r["target_id"], r["type"]) for r in rows["p/src/m.mjs"] if r["kind"] == "edge"}
    assert {("File:p/src/m.mjs", "Module:./x", "IMPORT"), ("File:p/src/m.mjs", "Module:y", "IMPORT"), ("File:p/src/m.mjs", "Export:function", "EXPORTS"), ("File:p/src/m.mjs", "Export:walk", "EXPORTS"), ("File:p/src/m.mjs", "Export:Gate", "EXPORTS")} <= edges
    assert not any("none" in t for _, t, _ in edges)
    assert {r["callee"] for r in rows["p/src/a/Door.java"] if r["kind"] == "call" and r["key"] == "a.b.Door.turn"} == {"hinge", "spin"}


def test_build_joins_calls_flow_and_statistics(spark):
    got = B.build(frame(spark).where("path not like 'p/lib%'"))
    edges = {(r["source_id"], r["target_id"], r["type"]) for r in got["edges"].collect()}
    assert {("Method:a.b.Door.turn", "Method:a.b.Door.hinge", "CALLS"), ("Method:a.b.Door.hinge", "Method:a.b.Door.turn", "CALLS"), ("Method:a.b.Door.Bell.ring", "Method:a.b.Door.hinge", "CALLS"), ("Method:m.Gate.open", "Function:m.walk", "CALLS"),
            ("Function:n::drain", "Method:n::Tank::level", "CALLS"), ("Method:n::Tank::fill", "GlobalVar:p/src/t.cpp:total", "WRITES"), ("Method:n::Tank::level", "GlobalVar:p/src/t.cpp:total", "READS"),
            ("Return:Method:n::Tank::level", "Var:Function:n::drain.return_value", "RETURNS_TO")} <= edges
    nodes = got["nodes"].collect()
    assert len(nodes) == len({r["id"] for r in nodes})
    s = got["statistics"].first()
    assert (s["files_java"], s["files_cpp"], s["files_javascript"], s["global_variables"], s["total_edges"]) == (1, 1, 1, 2, len(got["edges"].collect()))
    assert got["errors"].count() == 0 and got["metadata"].where("summary like 'Name: turn%'").count() == 1
    assert B.build(frame(spark).limit(0))["edges"].count() == 0


def test_tree_scan_and_documents(spark, tmp_path):
    for p, t in FILES.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    got = {r["path"] for r in tree.read_tree(spark, str(tmp_path / "p")).select("path").collect()}
    assert got == {"p/src/a/Door.java", "p/src/m.mjs", "p/src/t.cpp"}
    sinks.write_json_array(spark.createDataFrame([(1, None), (2, "ü")], "a int, b string"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"a": 1, "b": None}, {"a": 2, "b": "ü"}]
    sinks.write_build(B.build(tree.read_tree(spark, str(tmp_path / "p"))), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() > 10


def test_knowledge_base_shapes_and_command_line(spark, tmp_path):
    for name, doc in (("v", {"vectors": [{"node_id": "Function:a", "docstring": "Reads the page.", "path": "x.js", "embedding": [1.0, 0.0]}, {"summary": "no id"}]}), ("l", [{"name": "Method:b", "summary": "Turns the crank."}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert [(r["id"], r["clean"], r["summary"], r["file_path"], r["language"]) for r in tree.read_metadata(spark, str(tmp_path / "v.json")).collect()] == [("Function:a", "a", "Reads the page.", "x.js", "unknown")]
    assert [(r["id"], r["summary"]) for r in tree.read_metadata(spark, str(tmp_path / "l.json")).collect()] == [("Method:b", "Turns the crank.")]
    kb, req = tmp_path / "kb", tmp_path / "req"
    kb.mkdir()
    req.mkdir()
    (kb / "metadata.json").write_text((tmp_path / "v.json").read_text())
    (kb / "edges.json").write_text(json.dumps({"edges": [{"source_id": "Function:a", "target_id": "Function:b", "type": "CALLS"}, {"source_id": "", "target_id": "x", "type": "CALLS"}]}))
    (req / "r1.txt").write_text("Read the page.\n\nThen stop.")
    assert cli.main(["reason", str(kb), str(req), str(tmp_path / "res"), "--width", "2"]) == 0
    row = spark.read.parquet(str(tmp_path / "res")).first()
    assert (row["doc_id"], row["total_chunks"]) == ("r1", 1)


def test_reason_reads_what_build_writes(spark, tmp_path):
    src, req, kb = tmp_path / "s", tmp_path / "req", tmp_path / "kb"
    src.mkdir()
    req.mkdir()
    (src / "m.mjs").write_text("export function openLedger(page) { readPage(page); }\nexport function readPage(page) { turnCrank(page); }\nfunction turnCrank(page) { }\n")
    (req / "r1.txt").write_text("Function openLedger of page, language javascript, name openLedger, first line: export function openLedger(page).")
    assert cli.main(["build", str(src), str(kb), "--dataflow", "--width", "64", "--json"]) == 0
    assert spark.read.parquet(str(kb / "vectors")).count() == 3 and len(json.loads((kb / "metadata.json").read_text())) == 3
    for place in (str(kb), None):
        if place is None:  # the documents alone, whose index is built again
            place = str(tmp_path / "docs")
            (tmp_path / "docs").mkdir()
            for name in ("metadata.json", "edges.json"):
                (tmp_path / "docs" / name).write_text((kb / name).read_text())
        assert cli.main(["reason", place, str(req), str(tmp_path / "res"), "--width", "64"]) == 0
        row = spark.read.parquet(str(tmp_path / "res")).first()
        assert row["total_candidates"] >= 1 and "openLedger->m.readPage" in row["chain"].replace("Function:", "").replace("m.openLedger", "openLedger"), row


def test_prompts_unions_and_vectors_without_text(spark):
    rows = spark.createDataFrame([("a", " ", None, "x"), ("b", None, None, "  "), ("c", "Reads it.", "f()", "f")], "id string, summary string, signature string, name string")
    got = B.vectors_of(rows, lambda df, c: providers.embed(df, c, 8)).collect()
    assert {r["id"] for r in got} == {"c"} or {r["id"] for r in got} == {"a", "c"}  # "x" is too short to be a word
    asked = spark.createDataFrame([("Do it.", "a → b", ["n1: " + "y" * 200] + ["n"] * 5)], "r string, s string, d array<string>").select(providers.prompt(F.col("r"), F.col("s"), F.col("d")).alias("p")).first()["p"]
    assert asked.count("* n") == 4 and max(map(len, asked.split("\n"))) == 102 and "Judgment Reason" in asked


def test_providers_call_models_by_batch_and_survive_failures(spark):
    fn = spark.createDataFrame([("a", "a", "java", "int a()", "int a() { }"), ("b", "b", "java", "int b()", "")], "id string, name string, language string, signature string, code string")
    assert providers.summarize(fn, lambda p: "does " + p["name"]).where("summary like 'does %'").count() == 2
    assert providers.summarize(fn, lambda p: 1 / 0).where("summary like 'Summary failed%'").count() == 2
    vectors = providers.embed(fn, "name", 2, lambda t: [[1.0, float(len(x))] if x != "b" else [1.0] for x in t]).orderBy("id").collect()
    assert [list(r["embedding"]) for r in vectors] == [[1.0, 1.0], [0.0, 0.0]]
    judged = providers.judge(fn.select("id"), lambda p: p["id"].map({"a": "Overall Score: 0.9", "b": ""})).orderBy("id").collect()
    assert [r["scores"]["overall"] for r in judged] == [0.9, 0.5]


def test_stream_of_new_files(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark).where("path like '%java'").write.parquet(src)
    first = incremental.drain(incremental.new_facts(spark, src, frame(spark).schema))
    assert first.where(F.col("kind") == "node").count() > 5
