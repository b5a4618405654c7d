"""Functions paired with their documentation.

Signatures are found with a regular expression over the code with its literals and comments blanked, bodies are delimited
by a stack of braces, and a comment belongs to the function whose definition starts on the line after it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from ..parse import lexer as L
from ..parse.source import comment_above, comment_lines, functions

_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿß]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_TAG = re.compile(r"^(?:[@\\](\w+)|:(\w+)[^:]*:)\s*(.*)$")
_NAMED_TAGS = frozenset("param params arg argument property prop throws throw exception tparam template typeparam retval raises".split())
#: Comments that stand in for documentation.
_PLACEHOLDER = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|wip)\b\W*(?:\w+\W*){0,3}|n/?a|none|no-?op|nop|(?:see|as|same as)\s+(?:above|below|before)|ditto|descriptions?|(?:the\s+)?(?:method|function)\s+(?:comment|description|documentation|stub)|comments?|"
    r"(?:un)?documented|documentation|no\s+(?:comments?|description|documentation)|(?:write|add|needs?|missing)\s+(?:docs?|documentation|comments?)|to be (?:documented|done|defined)|"
    r"auto-?\s?generated\s+\w+\s+stub|\(?non-javadoc\)?|\{?@?inheritdoc\}?|placeholder|stub|dummy|work in progress|self-?explanatory|beschreibung|siehe oben|kommentar|待补充|待完善|无|暂无|说明|同上|描述|略)$",
    re.I,
)
_EMPTY_WORDS = frozenset(
    "a an the this that these those it its of for to in on at by with and or from as is are be will does do did method function procedure routine constructor operation member helper implementation "
    "implements implementing class object instance value values given get gets set sets getter setter perform performs performing execute executes run runs call calls called param parameter "
    "parameters argument arguments return returns returning result results void der die das ein eine methode funktion dieser diese dieses".split()
)
_CODE_END = re.compile(r"[;{}]$|^[})\]]+[;,]?$")
_CODE_SIGN = re.compile(r"[=(){}\[\]<>]|->|::|^(?:return|break|continue|else|try|throw|goto)\b|^\w+(?:\s+\w+)?;$")
_LICENCE = re.compile(r"copyright|spdx-|licen[cs]ed? (?:by|under)|all rights reserved", re.I)


@lru_cache(maxsize=1 << 16)
def _stem(word: str) -> str:
    w = word.lower()
    for end, least in (("ies", 4), ("es", 4), ("s", 3), ("ing", 5), ("ed", 4)):
        if w.endswith(end) and len(w) > least:
            w = w[: -len(end)] + ("y" if end == "ies" else "")
            break
    return w.rstrip("e")


def prose(comment: str) -> list[str]:
    """Lines of prose of a comment: no marks, separators, disabled code, licence lines, nor tags without words of their own."""
    rows = [x for x in comment_lines(comment) if x and re.search(r"\w", x)]
    code = [bool(_CODE_END.search(x) and _CODE_SIGN.search(x)) for x in rows]
    if rows and sum(code) * 2 >= len(rows):
        return []
    out = []
    for x, c in zip(rows, code):
        if c or _LICENCE.search(x):
            continue
        x = re.sub(r"</?[a-zA-Z][^<>]*>", " ", x)
        t = _TAG.match(x)
        if t and (t.group(1) or t.group(2)).lower() not in ("code",):
            tag, rest = (t.group(1) or t.group(2)).lower(), t.group(3)
            if tag in _NAMED_TAGS:
                rest = re.sub(r"^(?:\[[\w,]*\]\s*)?(?:\{[^}]*\}\s*)?[\w$.\[\]*&]+\s*[-:]?\s*", "", rest) if not t.group(2) else rest
            elif tag in ("return", "returns", "type"):
                rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
            elif tag in ("see", "since", "author", "version", "deprecated", "override", "inheritdoc", "private", "public", "static", "async", "function", "method", "name", "fn", "nodiscard"):
                rest = ""
            if re.search(r"\w", rest):
                out.append(rest)
            continue
        if re.search(r"\w", x):
            out.append(x)
    return out


def is_documentation(comment: str, name: str, signature: str) -> bool:
    """Whether the comment tells anything beyond the name and the signature of its function."""
    rows = prose(comment)
    text = " ".join(rows).strip()
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text) if not text.startswith("{@") else text
    if not bare or _PLACEHOLDER.match(bare):
        return False
    known = {_stem(w) for w in _SPLIT.findall(name + " " + signature)}
    if len(_CJK.findall(bare)) >= 4:
        return True
    fresh = {_stem(w) for w in _SPLIT.findall(bare) if len(w) > 1 and not w.isdigit() and w.lower() not in _EMPTY_WORDS} - known
    long = tuple(k for k in known if len(k) > 2)
    return any(len(w) <= 2 or not (w.startswith(long) or any(k.startswith(w) for k in long)) for w in fresh)


FOUND = "struct<func_name:string, name_line:int, end_line:int, signature:string, documentation:string, code:string>"
PAIRS = ("func_name", "name_line", "end_line", "signature", "documentation", "code")


def found(unit: L.Unit, with_code: bool = True) -> list[tuple]:
    """Rows of ``FOUND``: the documented functions of a file; without code the last three are null."""
    if not unit.comments:
        return []
    text, starts, out = unit.text, unit.starts, []
    for name, at, first, brace, end in functions(unit.language, text, unit):
        comment = comment_above(text, unit.comments, first, starts)
        if not comment:
            continue
        signature = " ".join(text[first:brace].split())
        if not is_documentation(comment, name, signature):
            continue
        more = (signature, " ".join(prose(comment)), text[first:end]) if with_code else (None, None, None)
        out.append((name.lstrip("#"), bisect_right(starts, at), bisect_right(starts, end - 1), *more))
    return out


def pairs(scanned: DataFrame, excluded: DataFrame) -> DataFrame:
    """(path, ...) distinct documented functions, columns of ``PAIRS``, from rows of (path, fault, pairs) as of ``scan``.

    Files of which a row has a fault and paths in ``excluded`` give none, nor do null or unknown paths, null and empty
    contents; repeated rows count once.
    """
    rows = scanned.where("path is not null")
    unwanted = rows.where("fault is not null").select("path").unionByName(excluded.select("path")).distinct()
    each = rows.where(F.size("pairs") > 0).select("path", F.explode("pairs").alias("x"))
    return each.join(unwanted, "path", "left_anti").select("path", *[F.col(f"x.{c}").alias(c) for c in PAIRS]).distinct()
