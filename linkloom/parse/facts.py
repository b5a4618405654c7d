"""Facts of the code graph from source text: nodes, containment, parameters, returns, calls, imports, exports, globals.

One file gives rows of one wide schema, tagged by ``kind``; everything that needs more than one file is relational
(``plans.build``). Ids are qualified throughout: Java ``package.Outer.Inner.m``, C++ ``ns::Cls::f``, JavaScript ``stem.Cls.f``.
A file that can't be read further gives its File node and an error row, never a failed task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import spread
from . import lexer as L
from .source import blanked, comment_above, comment_lines, frames, functions

FACTS = (
    "kind string, path string, ord int, id string, type string, name string, language string, signature string, start_line int, end_line int, data_type string, scope string, "
    "position int, comment string, code string, source_id string, target_id string, key string, callee string, detail string"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_CALL = {
    "java": re.compile(r"(?P<pre>\bnew\s+|\.\s*)?\b(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>\s*)?\("),
    "cpp": re.compile(r"(?P<pre>\bnew\s+)?(?P<n>(?:[A-Za-z_]\w*(?:::|\.|->))*~?[A-Za-z_]\w*)\s*(?:<[^<>()]*>\s*)?\("),
    "javascript": re.compile(r"(?P<pre>\bnew\s+|\bfunction\s+)?(?P<n>(?:[A-Za-z_$][\w$]*\s*\??\.\s*)*[A-Za-z_$][\w$]*)\s*\("),
}
_MEMBER = re.compile(r"(?:\.|->)\s*([A-Za-z_]\w*)(?!\w|\s*[(<:])")
_NOT_CALLS = frozenset("if for while switch catch return sizeof alignof decltype typeof synchronized try function super this new throw assert static_cast dynamic_cast const_cast reinterpret_cast await yield import defined noexcept".split())
_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default inline virtual explicit constexpr friend extern override async export".split())
_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', re.M)
_JS_EXPORT = re.compile(r"\bexport\s+(\{[^}]*\}|[\w$*]+)")
_DECLARED = re.compile(r"(?P<n>~?[A-Za-z_]\w*)\s*\((?P<p>[^(){};]*)\)\s*(?:const|noexcept|override|final|=\s*(?:0|default|delete)|\s)*;")
_GLOBAL = re.compile(r"(?:^|[;}])\s*((?:(?:static|const|constexpr|extern|unsigned|signed|inline|volatile)\s+)*[A-Za-z_][\w:]*(?:<[^<>;(){}]*>)?[\s*&]+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?:=[^;]*)?(?=;)")


def _split_top(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "(<[{":
            depth += 1
        elif c in ")>]}":
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [x.strip() for x in out if x.strip()]


def parameters(language: str, params: str) -> list[tuple[str, str]]:
    """(name, type) of each named parameter of a list without its parentheses."""
    found = []
    for item in _split_top(params):
        item = re.sub(r"@[\w.]+(?:\([^()]*\))?", " ", item.split("=")[0] if language != "java" else item)
        words = _WORD.findall(item)
        if language == "javascript":
            if words:
                found.append((words[0], "any"))
            continue
        if len(words) < 2 and not re.search(r"[*&\]]\s*\w+$", item):
            continue
        name = words[-1]
        kind = " ".join(w for w in re.sub(r"\b" + re.escape(name) + r"\b(?=[^\w]*$)", "", item).split() if w != "final")
        found.append((name, re.sub(r"\s*\[\s*\]", "[]", kind).strip()))
    return found


def _return_type(language: str, head: str) -> str:
    head = re.sub(r"@[\w.]+(?:\s*\([^()]*\))?|\[\[.*?\]\]|\btemplate\s*<[^<>]*(?:<[^<>]*>[^<>]*)*>", " ", head, flags=re.S)
    if language == "java":
        head = re.sub(r"^\s*((?:\w+\s+)*)<[^<>]*(?:<[^<>]*>[^<>]*)*>", r"\1", head)
    head = re.sub(r"(?:[\w]+(?:<[^<>]*>)?\s*::\s*)+$", "", head)
    return " ".join(w for w in head.split() if w not in _MODIFIERS) or "void"


def _cut(text: str, n: int) -> str:
    return text[:n]


def _modules(text: str, toks: list) -> list[str]:
    """Modules that JavaScript tokens name: a string after ``from``, or alone between the parentheses of ``require``."""
    said = [(k, text[a:b]) for k, a, b in toks if k != "c"]
    found = []
    for i, (kind, word) in enumerate(said):
        if kind != "s" or word[0] not in "'\"" or not i:
            continue
        called = said[max(0, i - 2) : i] == [("w", "require"), ("p", "(")] and said[i + 1 : i + 2] == [("p", ")")]
        if said[i - 1] == ("w", "from") or called:
            found.append(word[1:-1])
    return [x for x in found if x]


def extract(path: str, content: bytes | None, dataflow: bool = True) -> list[dict]:
    """Fact rows of one file; no language, no rows."""
    language = L.language_of(path)
    if language is None:
        return []
    rows: list[dict] = []

    def add(kind: str, **values) -> None:
        rows.append({"kind": kind, "path": path, "ord": len(rows), "language": language, **values})

    text = L.decode(content)
    file_id = f"File:{path}"
    add("node", id=file_id, type="File", name=path.rpartition("/")[2], start_line=1, end_line=text.count("\n") + 1)
    try:
        _extract(language, path, text, file_id, add, dataflow)
    except Exception as e:  # noqa: BLE001 one bad file must not stop the job
        add("error", detail=f"{type(e).__name__}: {e}"[:300])
    return rows


def _extract(language: str, path: str, text: str, file_id: str, add, dataflow: bool) -> None:
    unit = L.Unit(language, text)
    toks, comments, starts = unit.tokens, unit.comments, unit.starts
    code = blanked(unit.plain, toks)
    opened = frames(code)
    line = lambda at: bisect_right(starts, at)
    sep = "::" if language == "cpp" else "."
    base: list[str] = []
    if language == "java":
        m = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)
        base = [m.group(1)] if m else []
        for i, m in enumerate(_IMPORT.finditer(code)):
            add("import", target_id=m.group(1), position=i)
            add("edge", source_id=file_id, target_id=f"Module:{m.group(1)}", type="IMPORT", detail=m.group(1))
    elif language == "cpp":
        for i, m in enumerate(_INCLUDE.finditer(text)):
            add("import", target_id=m.group(1), position=i)
            add("edge", source_id=file_id, target_id=f"Module:{m.group(1)}", type="IMPORT", detail=m.group(1))
    else:
        base = [re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])]
        for i, name in enumerate(_modules(text, toks)):
            add("import", target_id=name, position=i)
            add("edge", source_id=file_id, target_id=f"Module:{name}", type="IMPORT", detail=name)
        for m in _JS_EXPORT.finditer(code):
            names = [re.sub(r"\s+as\s+.*", "", x).strip() for x in m.group(1)[1:-1].split(",")] if m.group(1)[0] == "{" else [m.group(1)]
            for name in filter(None, names):
                add("edge", source_id=file_id, target_id=f"Export:{name}", type="EXPORTS", detail=name)
    # types
    ids: dict[int, str] = {}
    close, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    for at, (kind, name, kinds, names, _) in opened.items():
        if kind != "type" or not name or (kinds and "other" in kinds):
            continue
        full = sep.join([*base, *[n for n in names if n], name])
        ids[at] = f"Class:{full}"
        start = max(code.rfind(c, 0, at) for c in ";{}") + 1
        start += len(code[start:at]) - len(code[start:at].lstrip())
        add("node", id=ids[at], type="Class", name=name, signature=_cut(" ".join(text[start:at].split()), 100) + " {...}", start_line=line(start), end_line=line(close.get(at, len(text) - 1)))
        owner = f"Class:{sep.join([*base, *[n for n in names if n]])}" if kinds and kinds[-1] == "type" else file_id
        add("edge", source_id=owner, target_id=ids[at], type="CONTAINS")
    # functions
    seen: set[str] = set()
    spans: list[tuple[int, int, str]] = []
    for name, at, first, brace, end in functions(language, text, unit):
        _, _, kinds, names, _ = opened[brace]
        owners = [n for n in names if n]
        in_type = bool(kinds) and kinds[-1] == "type"
        if language == "cpp" and (m := re.search(r"((?:\w+(?:<[^<>]*>)?\s*::\s*)+)$", code[max(0, at - 200) : at])):
            owners += [re.sub(r"<.*?>|\s", "", x) for x in m.group(1).split("::") if x.strip()]
            in_type = True
        full = sep.join([*base, *owners, name.lstrip("#")])
        node = ("Method" if language == "java" or in_type else "Function") + ":" + full
        spans.append((first, end, node))
        add("symbol", key=full, id=node)
        if full in seen:
            continue  # the first of overloads stands
        seen.add(full)
        head, params = code[first:at], re.search(r"\((.*)\)", code[at:brace], re.S)
        signature = " ".join(text[first:brace].split())
        returns = _return_type(language, head) if language != "javascript" else "any"
        doc = comment_above(text, comments, first, starts)
        add("node", id=node, type=node.partition(":")[0], name=name.lstrip("#"), signature=_cut(signature, 200), start_line=line(first), end_line=line(end - 1), data_type=returns, comment=" ".join(x for x in comment_lines(doc) if x) or "No comments", code=text[first:end])
        owner = f"Class:{sep.join([*base, *owners])}" if in_type else file_id
        add("edge", source_id=owner, target_id=node, type="CONTAINS", detail="method" if in_type else "function")
        calls = {}
        for m in _CALL[language].finditer(code, brace, end):
            callee = re.sub(r"\s", "", m.group("n"))
            pre = (m.group("pre") or "").strip()
            simple = re.split(r"::|\.|->", callee)[-1]
            if pre in ("new", "function") or simple in _NOT_CALLS or len(callee) >= 100:
                continue
            calls.setdefault(callee if language != "cpp" else re.sub(r"^.*(?:\.|->)", "", callee), None)
        if language == "cpp":  # members that are only read count as well
            for m in _MEMBER.finditer(code, brace, end):
                calls.setdefault(m.group(1), None)
        for callee in calls:
            add("call", key=full, id=node, callee=callee)
        if dataflow and language != "javascript":
            for i, (pname, ptype) in enumerate(parameters(language, params.group(1) if params else "")):
                pid = f"Param:{node}.{pname}"
                add("node", id=pid, type="Parameter", name=pname, data_type=ptype, scope=node, position=i)
                add("edge", source_id=node, target_id=pid, type="HAS_PARAMETER", position=i, detail=ptype)
            if returns.lower() != "void":
                add("node", id=f"Return:{node}", type="ReturnValue", name=f"{name}_return", data_type=returns, scope=node)
                add("edge", source_id=node, target_id=f"Return:{node}", type="RETURNS", detail=returns)
    if language != "cpp":
        return
    # members that are only declared, and globals
    masked = list(code)
    for a, b, _ in spans:
        masked[a:b] = [c if c == "\n" else " " for c in masked[a:b]]
    outside = "".join(masked)
    for at, owner in ids.items():
        for m in _DECLARED.finditer(outside, at, close.get(at, len(outside))):
            full = owner[len("Class:") :] + "::" + m.group("n")
            if full in seen or m.group("n") in _NOT_CALLS or m.group("n") == owner.rpartition("::")[2].rpartition(":")[2]:
                continue
            seen.add(full)
            add("node", id=f"Method:{full}", type="Method", name=m.group("n"), signature=_cut(" ".join(m.group().split())[:-1].strip(), 120) + ";", start_line=line(m.start()), end_line=line(m.end() - 1), detail="declared_only")
            add("edge", source_id=owner, target_id=f"Method:{full}", type="CONTAINS", detail="method")
    if dataflow:
        held: dict[str, str] = {}
        for at in ids:
            outside = outside[:at] + re.sub(r"[^\n]", " ", outside[at : close.get(at, at) + 1]) + outside[close.get(at, at) + 1 :]
        for m in _GLOBAL.finditer(re.sub(r"\bnamespace\s+[\w:]*\s*\{", lambda x: ";" + " " * (len(x.group()) - 1), outside)):
            kind = " ".join(m.group(1).split())
            if kind.split()[0] in ("return", "using", "typedef", "namespace", "template", "public", "private", "protected", "class", "struct", "enum"):
                continue
            gid = f"GlobalVar:{path}:{m.group(2)}"
            add("node", id=gid, type="GlobalVariable", name=m.group(2), data_type=kind, start_line=line(m.start(2)), end_line=line(m.start(2)))
            held[m.group(2)] = gid
        for a, b, node in spans if held else ():
            body = code[a:b]
            for name in sorted(held.keys() & set(_WORD.findall(body))):
                writes = re.search(rf"\b{name}\s*=[^=]", body)
                add("edge", source_id=node, target_id=held[name], type="WRITES" if writes else "READS")


def facts(files: DataFrame, dataflow: bool = True) -> DataFrame:
    """Rows of ``FACTS`` of all files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for p, c in part[["path", "content"]].itertuples(index=False, name=None) if p is not None for r in extract(p, c, dataflow)]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})

    return spread(files.select("path", "content")).mapInPandas(run, FACTS)
