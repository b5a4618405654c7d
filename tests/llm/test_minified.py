import re

from linkloom.llm import handwritten as H
from linkloom.parse import lexer as L

from test_handwritten import HAND, judged

UNIT = 'function {0}(e,t){{var n=[],r=0;for(;r<e.length;r++)n.push(t(e[r],{1}));return n}}var {2}={{k:{0},z:{1}}};'
NAMES = [a + b for a in "abcdefgh" for b in "qwxzj"]


def bundle(texts):
    return "".join(UNIT.format(x, f'"{texts}"', x.upper()) for x in NAMES)


def test_minified_files_with_many_strings_and_wrapped_ones(spark):
    message = "the boat is not in the harbor "
    full = bundle(message)
    wrapped = re.sub(r"(.{70}[^\w\"$]*)(?=[;,{}])", r"\1\n", bundle("k"))
    share = dict(zip(H.COLUMNS, H.describe("r/m.js", "r", L.Unit("javascript", full))))
    assert H.DATA_SHARE > share["literal"] > 0.2 and max(map(len, wrapped.split("\n"))) < 150
    hand = [(f"r/H{i}.java", HAND.replace("Tide", f"Tide{i}"), "r") for i in range(10)] + [("r/s.js", "let a = 1;\nlet b = a;\n", "r"), ("r/t.js", "f();\n", "r")]
    got = judged(spark, [("r/m.js", full, "r"), ("r/w.js", wrapped, "r"), *hand])
    assert "minified" in got["r/m.js"] and "minified" in got["r/w.js"]
    assert not any("minified" in got[p] for p, _, _ in hand)
