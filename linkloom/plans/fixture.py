"""Extraction from source text on files small enough to count by hand; the expected rows are written out as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..parse.facts import facts
from . import build

FILES = {
    "shop/src/Till.java": """package shop.desk;
import java.util.List;
import static java.lang.Math.*;
/** Counts coins. */
public class Till {
    private int sum;
    Till() { sum = 0; }
    // Adds a coin.
    public int add(final int coin, List<String> log) { note(log); sum += coin; return total(); }
    int total() { return sum; }
    void note(List<String> log) { log.add("coin"); new Till(); }
    static class Drawer {
        void open() { total(); Slot.turn("key"); }
    }
}
interface Slot { void turn(String key); }
""",
    "shop/src/stock.cpp": """#include <vector>
#include "shelf.h"
namespace stock {
int level;
static const int kMost = 9;
class Shelf {
public:
    Shelf() {}
    int room() const;
    void put(int n) { level = level + n; check(n); }
    void sweep();
};
int Shelf::room() const { return kMost - level; }
bool check(int n) {
#if 0
    broken((
#endif
    Shelf s;
    return s.room() > n && s.tag.size;
}
}
""",
    "shop/src/cart.mjs": """import base, { price } from './price.mjs';
const tax = require("tax");
// import lost from 'nowhere';
export function fill(cart, n = 1) { price(n); cart.push(n); }
class Cart extends base {
    #load(x) { return tax.of(x); }
    async pay({ card }) { this.#load(card); fill(this, 2); }
}
export { Cart, fill as pack };
export { rate } from "./rate.mjs";
""",
    "shop/src/empty.java": "",
    "shop/notes.txt": "class Nothing { }",
}


def _facts(spark: SparkSession) -> DataFrame:
    return facts(spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary"))


def fixture_nodes(spark, d):
    return _facts(spark).where("kind = 'node'").select("id", "type", "name", "data_type", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start_line", "end_line")])


def fixture_signatures(spark, d):
    return _facts(spark).where("kind = 'node' and signature is not null").select("id", "signature", "comment")


def fixture_edges(spark, d):
    return _facts(spark).where("kind = 'edge'").select("source_id", "target_id", "type").distinct()


def fixture_calls(spark, d):
    return _facts(spark).where("kind = 'call'").select("key", "callee").distinct()


def fixture_graph(spark, d):
    """Edges of the build beyond single files: resolved calls and the data flow along them."""
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    return build.build(files)["edges"].where("type in ('CALLS', 'PASSES_TO', 'RETURNS_TO')").select("source_id", "target_id", "type").distinct()


def fixture_enhanced(spark, d):
    rows = _facts(spark)
    return build.enhanced(rows, "cpp").unionByName(build.enhanced(rows, "javascript"))


QUERIES = {f.__name__: f for f in (fixture_nodes, fixture_signatures, fixture_edges, fixture_calls, fixture_graph, fixture_enhanced)}

def _values(rows: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


#: Counted by hand from the files above.
SQL = {
    "fixture_nodes": _values(
        """
     ('Class:cart.Cart', 'Class', 'Cart', NULL, 5, 8), ('Class:shop.desk.Slot', 'Class', 'Slot', NULL, 16, 16), ('Class:shop.desk.Till', 'Class', 'Till', NULL, 5, 15),
     ('Class:shop.desk.Till.Drawer', 'Class', 'Drawer', NULL, 12, 14), ('Class:stock::Shelf', 'Class', 'Shelf', NULL, 6, 12), ('File:shop/src/Till.java', 'File', 'Till.java', NULL, 1, 17),
     ('File:shop/src/cart.mjs', 'File', 'cart.mjs', NULL, 1, 11), ('File:shop/src/empty.java', 'File', 'empty.java', NULL, 1, 1),
     ('File:shop/src/stock.cpp', 'File', 'stock.cpp', NULL, 1, 22), ('Function:cart.fill', 'Function', 'fill', 'any', 4, 4), ('Function:stock::check', 'Function', 'check', 'bool', 14, 20),
     ('GlobalVar:shop/src/stock.cpp:kMost', 'GlobalVariable', 'kMost', 'static const int', 5, 5), ('GlobalVar:shop/src/stock.cpp:level', 'GlobalVariable', 'level', 'int', 4, 4),
     ('Method:cart.Cart.load', 'Method', 'load', 'any', 6, 6), ('Method:cart.Cart.pay', 'Method', 'pay', 'any', 7, 7), ('Method:shop.desk.Till.Drawer.open', 'Method', 'open', 'void', 13, 13),
     ('Method:shop.desk.Till.add', 'Method', 'add', 'int', 9, 9), ('Method:shop.desk.Till.note', 'Method', 'note', 'void', 11, 11),
     ('Method:shop.desk.Till.total', 'Method', 'total', 'int', 10, 10), ('Method:stock::Shelf::put', 'Method', 'put', 'void', 10, 10),
     ('Method:stock::Shelf::room', 'Method', 'room', 'int', 13, 13), ('Method:stock::Shelf::sweep', 'Method', 'sweep', NULL, 11, 11),
     ('Param:Function:stock::check.n', 'Parameter', 'n', 'int', 0, 0), ('Param:Method:shop.desk.Till.add.coin', 'Parameter', 'coin', 'int', 0, 0),
     ('Param:Method:shop.desk.Till.add.log', 'Parameter', 'log', 'List<String>', 0, 0), ('Param:Method:shop.desk.Till.note.log', 'Parameter', 'log', 'List<String>', 0, 0),
     ('Param:Method:stock::Shelf::put.n', 'Parameter', 'n', 'int', 0, 0), ('Return:Function:stock::check', 'ReturnValue', 'check_return', 'bool', 0, 0),
     ('Return:Method:shop.desk.Till.add', 'ReturnValue', 'add_return', 'int', 0, 0), ('Return:Method:shop.desk.Till.total', 'ReturnValue', 'total_return', 'int', 0, 0),
     ('Return:Method:stock::Shelf::room', 'ReturnValue', 'room_return', 'int', 0, 0)
""",
        "id, type, name, data_type, start_line, end_line",
    ),
    "fixture_signatures": _values(
        """
     ('Class:cart.Cart', 'class Cart extends base {...}', NULL), ('Class:shop.desk.Slot', 'interface Slot {...}', NULL), ('Class:shop.desk.Till', 'public class Till {...}', NULL),
     ('Class:shop.desk.Till.Drawer', 'static class Drawer {...}', NULL), ('Class:stock::Shelf', 'class Shelf {...}', NULL),
     ('Function:cart.fill', 'export function fill(cart, n = 1)', 'import lost from ''nowhere'';'), ('Function:stock::check', 'bool check(int n)', 'No comments'),
     ('Method:cart.Cart.load', '#load(x)', 'No comments'), ('Method:cart.Cart.pay', 'async pay({ card })', 'No comments'), ('Method:shop.desk.Till.Drawer.open', 'void open()', 'No comments'),
     ('Method:shop.desk.Till.add', 'public int add(final int coin, List<String> log)', 'Adds a coin.'), ('Method:shop.desk.Till.note', 'void note(List<String> log)', 'No comments'),
     ('Method:shop.desk.Till.total', 'int total()', 'No comments'), ('Method:stock::Shelf::put', 'void put(int n)', 'No comments'),
     ('Method:stock::Shelf::room', 'int Shelf::room() const', 'No comments'), ('Method:stock::Shelf::sweep', 'sweep();', NULL)
""",
        "id, signature, comment",
    ),
    "fixture_edges": _values(
        """
     ('Class:cart.Cart', 'Method:cart.Cart.load', 'CONTAINS'), ('Class:cart.Cart', 'Method:cart.Cart.pay', 'CONTAINS'), ('Class:shop.desk.Till', 'Class:shop.desk.Till.Drawer', 'CONTAINS'),
     ('Class:shop.desk.Till', 'Method:shop.desk.Till.add', 'CONTAINS'), ('Class:shop.desk.Till', 'Method:shop.desk.Till.note', 'CONTAINS'),
     ('Class:shop.desk.Till', 'Method:shop.desk.Till.total', 'CONTAINS'), ('Class:shop.desk.Till.Drawer', 'Method:shop.desk.Till.Drawer.open', 'CONTAINS'),
     ('Class:stock::Shelf', 'Method:stock::Shelf::put', 'CONTAINS'), ('Class:stock::Shelf', 'Method:stock::Shelf::room', 'CONTAINS'),
     ('Class:stock::Shelf', 'Method:stock::Shelf::sweep', 'CONTAINS'), ('File:shop/src/Till.java', 'Class:shop.desk.Slot', 'CONTAINS'),
     ('File:shop/src/Till.java', 'Class:shop.desk.Till', 'CONTAINS'), ('File:shop/src/Till.java', 'Module:java.lang.Math.*', 'IMPORT'),
     ('File:shop/src/Till.java', 'Module:java.util.List', 'IMPORT'), ('File:shop/src/cart.mjs', 'Class:cart.Cart', 'CONTAINS'), ('File:shop/src/cart.mjs', 'Export:Cart', 'EXPORTS'),
     ('File:shop/src/cart.mjs', 'Export:fill', 'EXPORTS'), ('File:shop/src/cart.mjs', 'Export:function', 'EXPORTS'), ('File:shop/src/cart.mjs', 'Export:rate', 'EXPORTS'),
     ('File:shop/src/cart.mjs', 'Function:cart.fill', 'CONTAINS'), ('File:shop/src/cart.mjs', 'Module:./price.mjs', 'IMPORT'), ('File:shop/src/cart.mjs', 'Module:./rate.mjs', 'IMPORT'),
     ('File:shop/src/cart.mjs', 'Module:tax', 'IMPORT'), ('File:shop/src/stock.cpp', 'Class:stock::Shelf', 'CONTAINS'), ('File:shop/src/stock.cpp', 'Function:stock::check', 'CONTAINS'),
     ('File:shop/src/stock.cpp', 'Module:shelf.h', 'IMPORT'), ('File:shop/src/stock.cpp', 'Module:vector', 'IMPORT'),
     ('Function:stock::check', 'Param:Function:stock::check.n', 'HAS_PARAMETER'), ('Function:stock::check', 'Return:Function:stock::check', 'RETURNS'),
     ('Method:shop.desk.Till.add', 'Param:Method:shop.desk.Till.add.coin', 'HAS_PARAMETER'), ('Method:shop.desk.Till.add', 'Param:Method:shop.desk.Till.add.log', 'HAS_PARAMETER'),
     ('Method:shop.desk.Till.add', 'Return:Method:shop.desk.Till.add', 'RETURNS'), ('Method:shop.desk.Till.note', 'Param:Method:shop.desk.Till.note.log', 'HAS_PARAMETER'),
     ('Method:shop.desk.Till.total', 'Return:Method:shop.desk.Till.total', 'RETURNS'), ('Method:stock::Shelf::put', 'GlobalVar:shop/src/stock.cpp:level', 'WRITES'),
     ('Method:stock::Shelf::put', 'Param:Method:stock::Shelf::put.n', 'HAS_PARAMETER'), ('Method:stock::Shelf::room', 'GlobalVar:shop/src/stock.cpp:kMost', 'READS'),
     ('Method:stock::Shelf::room', 'GlobalVar:shop/src/stock.cpp:level', 'READS'), ('Method:stock::Shelf::room', 'Return:Method:stock::Shelf::room', 'RETURNS')
""",
        "source_id, target_id, type",
    ),
    "fixture_calls": _values(
        """
     ('cart.Cart.load', 'tax.of'), ('cart.Cart.pay', 'fill'), ('cart.Cart.pay', 'load'), ('cart.fill', 'cart.push'), ('cart.fill', 'price'), ('shop.desk.Till.Drawer.open', 'total'),
     ('shop.desk.Till.Drawer.open', 'turn'), ('shop.desk.Till.add', 'note'), ('shop.desk.Till.add', 'total'), ('shop.desk.Till.note', 'add'), ('stock::Shelf::put', 'check'),
     ('stock::check', 'room'), ('stock::check', 'size'), ('stock::check', 'tag')
""",
        "key, callee",
    ),
    "fixture_graph": _values(
        """
     ('Function:stock::check', 'Method:stock::Shelf::room', 'CALLS'), ('Method:cart.Cart.pay', 'Function:cart.fill', 'CALLS'), ('Method:cart.Cart.pay', 'Method:cart.Cart.load', 'CALLS'),
     ('Method:shop.desk.Till.Drawer.open', 'Method:shop.desk.Till.total', 'CALLS'), ('Method:shop.desk.Till.add', 'Method:shop.desk.Till.note', 'CALLS'),
     ('Method:shop.desk.Till.add', 'Method:shop.desk.Till.total', 'CALLS'), ('Method:shop.desk.Till.note', 'Method:shop.desk.Till.add', 'CALLS'),
     ('Method:stock::Shelf::put', 'Function:stock::check', 'CALLS'), ('Param:Method:shop.desk.Till.add.coin', 'Param:Method:shop.desk.Till.note.log', 'PASSES_TO'),
     ('Param:Method:shop.desk.Till.note.log', 'Param:Method:shop.desk.Till.add.coin', 'PASSES_TO'), ('Param:Method:stock::Shelf::put.n', 'Param:Function:stock::check.n', 'PASSES_TO'),
     ('Return:Function:stock::check', 'Var:Method:stock::Shelf::put.return_value', 'RETURNS_TO'),
     ('Return:Method:shop.desk.Till.add', 'Var:Method:shop.desk.Till.note.return_value', 'RETURNS_TO'),
     ('Return:Method:shop.desk.Till.total', 'Var:Method:shop.desk.Till.Drawer.open.return_value', 'RETURNS_TO'),
     ('Return:Method:shop.desk.Till.total', 'Var:Method:shop.desk.Till.add.return_value', 'RETURNS_TO'),
     ('Return:Method:stock::Shelf::room', 'Var:Function:stock::check.return_value', 'RETURNS_TO')
""",
        "source_id, target_id, type",
    ),
    "fixture_enhanced": """SELECT source_id, target_id, type, language FROM (VALUES
      ('Function:stock::check', 'Method:stock::Shelf::room', 'CALLS'),
      ('Method:cart.Cart.pay', 'Function:cart.fill', 'CALLS'),
      ('Method:cart.Cart.pay', 'Method:cart.Cart.load', 'CALLS'),
      ('Method:shop.desk.Till.Drawer.open', 'Method:shop.desk.Till.total', 'CALLS'),
      ('Method:shop.desk.Till.add', 'Method:shop.desk.Till.note', 'CALLS'),
      ('Method:shop.desk.Till.add', 'Method:shop.desk.Till.total', 'CALLS'),
      ('Method:shop.desk.Till.note', 'Method:shop.desk.Till.add', 'CALLS'),
      ('Method:stock::Shelf::put', 'Function:stock::check', 'CALLS')) AS t(source_id, target_id, type), (VALUES ('cpp'), ('javascript')) AS l(language)""",
}
