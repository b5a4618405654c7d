"""Functions, types and comments of source files, found in text whose literals and comments are blanked.

Signatures are found with a regular expression, bodies are delimited by a stack of braces, and a comment belongs to the
function whose definition starts on the line after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from . import lexer as L

_NOT_NAMES = frozenset(
    "if for while switch catch return new else do try synchronized throw sizeof alignof decltype typeof delete case function await yield assert super this static_assert defined with in of instanceof "
    "int long short char float double bool boolean void auto const noexcept requires alignas and or not operator template".split()
)
#: A name and what follows it up to its parameter list, which brackets delimit as it may hold braces.
_SIGNATURE = {
    "java": re.compile(r"(?<![\w$])(?P<name>[^\W\d][\w$]*)\s*(?P<list>\()"),
    "cpp": re.compile(r"(?<!\w)(?P<name>~?[^\W\d]\w*)\s*(?P<list>\()"),
    "javascript": re.compile(
        r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?P<list>\()"
        r"|(?<![\w$#])(?P<name2>#?[\w$]+)\s*(?P<mark>[=:])\s*(?:async\s*)?(?:function\s*\*?\s*(?P<own>[\w$]+\s*)?(?P<list2>\()|(?P<arrow>\()|[\w$]+\s*=>\s*(?P<open2>\{))"
        r"|(?<![\w$#])(?P<name3>#?[\w$]+)\s*(?P<list3>\()"
    ),
}
#: What may stand between the parameter list and the body, and the opening brace.
_BODY = {
    "java": re.compile(r"\s*(?:throws\s+[\w$.,\s<>@]+)?\s*(?P<open>\{)"),
    "cpp": re.compile(
        r"\s*(?:(?:const|volatile|override|final|mutable|&&?|try|noexcept(?:\s*\([^()]*\))?|throw\s*\([^()]*\)|->\s*[\w:<>,*&\s]+|requires\s[^{;]*|\b[A-Z_]{3,}\b)\s*)*(?::\s*(?!:)[^{};]*)?(?P<open>\{)"
    ),
    "javascript": re.compile(r"\s*(?P<open>\{)"),
    "arrow": re.compile(r"\s*=>\s*(?P<open>\{)"),
}


def blanked(text: str, toks: list) -> str:
    """The text with comments and literals blanked; line ends and positions stay."""
    out, at = [], 0
    for k, a, b in toks:
        if k in "cstux":
            out.append(text[at:a])
            piece = text[a:b]
            if k == "t" and piece.endswith("${"):
                out.append(re.sub(r"[^\r\n]", " ", piece[:-1]) + "{" if piece[0] == "`" else "}" + re.sub(r"[^\r\n]", " ", piece[1:-1]) + "{")
            elif k == "t" and piece[0] == "}":
                out.append("}" + re.sub(r"[^\r\n]", " ", piece[1:]))
            else:
                out.append(re.sub(r"[^\r\n]", " ", piece) if "\n" in piece or "\r" in piece else " " * (b - a))
            at = b
    out.append(text[at:])
    return "".join(out)


_TYPE = re.compile(r"\b(?:class|struct|interface|enum|record|union|namespace)\b(?!.*[=;])", re.S)


_TYPE_WORDS = ("class", "struct", "interface", "enum", "record", "union", "namespace", "extern")


def _opens(head: str) -> tuple[str, str]:
    """What the brace after ``head`` opens, a space, a type or something else, and its name."""
    if re.search(r"\bnamespace\b[\w:\s]*$", head) or re.search(r"\bextern\s*$", head):
        n = re.search(r"\bnamespace\s+([\w:]+)\s*$", head)
        return "space", n.group(1) if n else ""
    t = _TYPE.search(head)
    if t and not re.search(r"\)\s*(?:const|override|noexcept|final|\s)*$", head.split("class")[0] if "class" in head else head):
        n = re.search(r"\b(?:class|struct|interface|enum|record|union)\s+(?:class\s+|struct\s+)?(?:\[\[[^\]]*\]\]\s*)?([\w$]+)", head)
        return "type", n.group(1) if n else ""
    if t and re.search(r"\b(?:class|struct|interface|enum|record)\b", head) and not re.search(r"\)\s*$", head):
        return "type", ""
    return "other", ""


def frames(code: str) -> dict[int, tuple]:
    """Of each opening brace: (what it opens, the name of the type or namespace, the same of the braces around it, the place of
    the innermost of these or -1), by the text between it and the statement before."""
    found, stack = {}, []
    start = 0
    for m in re.finditer(r"[{};]", code):
        at = m.start()
        if m.group() == "{":
            kind, name = "other", ""
            head = code[start:at]
            if any(w in head for w in _TYPE_WORDS):
                kind, name = _opens(head)
            found[at] = (kind, name, tuple(k for k, _, _ in stack), tuple(n for _, n, _ in stack), stack[-1][2] if stack else -1)
            stack.append((kind, name, at))
        elif m.group() == "}" and stack:
            stack.pop()
        start = at + 1
    return found


def _parentheses(code: str) -> dict[int, int]:
    """The other end of each parenthesis; one that a brace leaves open has none."""
    ends, stack = {}, []
    for m in re.finditer(r"[(){}]", code):
        c, at = m.group(), m.start()
        if c in "({":
            stack.append((c, at))
        elif c == ")":
            if stack and stack[-1][0] == "(":
                o = stack.pop()[1]
                ends[o], ends[at] = at, o
        else:
            while stack and stack.pop()[0] != "{":
                pass
    return ends


def _statement(code: str, at: int, ends: dict[int, int]) -> int:
    """Where the definition whose name is at ``at`` starts: after the statement before, braces of its annotations apart."""
    until = at
    while True:
        last = max(code.rfind(c, 0, until) for c in ";{}")
        q = code.find(")", last + 1, until)
        while q >= 0 and ends.get(q, q) > last:
            q = code.find(")", q + 1, until)
        if q < 0:
            return last + 1
        if q not in ends or not re.search(r"@[\w.$]+\s*$", code[max(0, ends[q] - 100) : ends[q]]):
            return q + 1  # the end of a call whose arguments hold braces
        until = ends[q]


def functions(language: str, text: str, unit: L.Unit | None = None) -> list[tuple[str, int, int, int, int]]:
    """(name, offset of the name, offset where the definition starts, opening brace, end of the body) of functions with a body.

    Functions, methods of local and anonymous classes and of object literals count at any depth. In JavaScript a function
    that only a variable or property names counts where no other function is around it but the wrapper of a module.
    unit: the lexed text, where there is one already.
    """
    unit = unit or L.Unit(language, text)
    code = blanked(unit.plain, unit.tokens)
    opened = frames(code)
    ends = _parentheses(code)
    close, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    out = []
    pos, rx = 0, _SIGNATURE[language]
    while m := rx.search(code, pos):
        group = m.groupdict()
        which = "" if group.get("name") else "2" if language == "javascript" and group["name2"] else "3"
        name, at = m.group("name" + which), m.start("name" + which)
        pos = m.end("name" + which)
        if name in _NOT_NAMES:
            continue
        arrow = which == "2" and group["arrow"]
        if which == "2" and group["open2"]:
            brace = m.start("open2")
        else:
            end = ends.get(m.start("arrow" if arrow else "list" + ("" if language != "javascript" else which)))
            body = end is not None and _BODY["arrow" if arrow else language].match(code, end + 1)
            if not body:
                continue
            brace = body.start("open")
        if brace not in close:
            continue
        pos = brace
        frame = opened.get(brace)
        around, names = frame[2], frame[3]
        inside = around[-1] if around else "space"
        before = code[max(0, at - 300) : at]
        start = _statement(code, at, ends)
        head = code[start:at]
        if language == "java":
            if inside != "type" and not _in_nameless_class(code, frame, opened, ends) or re.search(r"\bnew\s+[\w$.<>\s]*$|[=.,]\s*$", before):
                continue
            kinds = re.sub(r"@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?", " ", head).split()
            if not [k for k in kinds if k not in ("public", "private", "protected")] or name == names[-1]:
                continue  # a constructor
        elif language == "cpp":
            if inside == "other":
                continue
            label = re.search(r"(?:^|\s)(?:public|private|protected)\s*:(?!:)\s*", head)
            if label:
                start += label.end()
                head = code[start:at]
            if name.startswith("~") or re.search(r"[=.,(]\s*$|->\s*$|\boperator\W*$|\breturn\s*$", before):
                continue
            owner = re.search(r"([\w]+)\s*(?:<[^<>]*>)?\s*::\s*$", before)
            if (owner and owner.group(1) == name) or (not owner and names and inside == "type" and names[-1] == name):
                continue
            if not owner and not re.search(r"[\w>*&\]]\s*$", re.sub(r"\[\[.*?\]\]", " ", head, flags=re.S)):
                continue  # no return type: a macro
        else:
            member = inside == "type" or _in_object(code, frame)
            if which == "3" and not member:
                continue
            if which == "2" and not group["own"] and not (member and (inside == "type" or group["mark"] == ":")) and not _at_top(code, frame, opened, ends):
                continue
            if name == "constructor" or re.search(r"\bnew\s*$|\.\s*$", before) and which == "3":
                continue
        # the first line of the definition is that of its first token that is no comment
        first = start + len(code[start:at]) - len(code[start:at].lstrip())
        out.append((name, at, min(first, at), brace, close[brace] + 1))
    return out


def _in_nameless_class(code: str, frame: tuple, opened: dict[int, tuple], ends: dict[int, int]) -> bool:
    """Whether the innermost brace around opens the body of a Java anonymous class or enum constant."""
    if frame[4] < 0:
        return False
    at = len(code[: frame[4]].rstrip())
    if code[:at].endswith(")"):
        if at - 1 not in ends:
            return False
        at = len(code[: ends[at - 1]].rstrip())
        if re.search(r"\bnew\s+(?:@[\w.]+\s+)*[\w$.]+\s*(?:<[^(){};]*>)?$", code[max(0, at - 300) : at]):
            return True
    outer = opened[frame[4]][4]
    if outer < 0 or opened[outer][0] != "type":
        return False
    head = code[max(code.rfind(c, 0, outer) for c in ";{}") + 1 : outer]
    return bool(re.search(r"\benum\s+[\w$]+", head) and re.search(r"[{,]\s*(?:@[\w.]+\s+)*[\w$]+$", code[max(0, at - 300) : at]))


def _in_object(code: str, frame: tuple) -> bool:
    """Whether the innermost brace around is that of an object literal."""
    if frame[4] < 0 or frame[2][-1] != "other":
        return False
    before = code[max(0, frame[4] - 40) : frame[4]]
    return bool(re.search(r"[=(:,\[?&|]\s*$|\breturn\s*$|\bdefault\s*$", before)) and not re.search(r"\)\s*$|=>\s*$|\bcase\b[^:;{}]*:\s*$|\bdefault\s*:\s*$", before)


def _at_top(code: str, frame: tuple, opened: dict[int, tuple], ends: dict[int, int]) -> bool:
    """Whether nothing but types and wrappers of the module is around: functions called on the spot, define's or a factory."""
    at = frame[4]
    while at >= 0:
        if opened[at][0] == "other" and not _wraps(code, at, ends):
            return False
        at = opened[at][4]
    return True


def _wraps(code: str, brace: int, ends: dict[int, int]) -> bool:
    lead = code[max(0, brace - 2000) : brace].rstrip()
    arrow = lead.endswith("=>")
    if arrow:
        lead = lead[:-2].rstrip()
    if not lead.endswith(")"):
        return False
    place = brace - len(code[max(0, brace - 2000) : brace]) + len(lead) - 1
    if place not in ends:
        return False
    lead = code[max(0, ends[place] - 300) : ends[place]]
    if not arrow:
        lead, n = re.subn(r"\bfunction\s*\*?\s*[\w$]*\s*$", "", lead)
        if not n:
            return False
    lead = re.sub(r"\basync\s*$", "", lead).rstrip()
    return bool(re.search(r"(?:^|[^\w$)\]\s])\s*\($|(?:^|[;{}\n])\s*(?:[!+~-]|void)$|\bdefine\s*\([^(){};]*$|[)}]\s*\([^(){};]*,$", lead))


def comment_lines(comment: str) -> list[str]:
    """The comment's lines without its marks."""
    body = []
    for x in comment.replace("\r", "").split("\n"):
        x = re.sub(r"\s*\*+/\s*$", "", x)
        x = re.sub(r"^\s*(?:/\*[*!]*<?|//[/!]*<?|\*+)\s?", "", x)
        body.append(x.strip())
    return body


def comment_above(text: str, comments: list, first: int, starts: list[int]) -> str:
    """The comment that ends on the line above the line of ``first``; touching line comments are one comment.

    comments: the comment tokens in order, starts: where the lines start.
    """
    line = bisect_right(starts, first)  # 1-based
    out: list[str] = []
    want = line - 1
    at = bisect_left(comments, first, key=lambda t: t[1])
    while at and want:
        at -= 1
        _, a, b = comments[at]
        end = bisect_right(starts, max(a, b - 1))
        if end < want:
            break
        if end > want:
            continue
        begin = bisect_right(starts, a)
        if text[starts[begin - 1] : a].strip():
            break  # it ends a line of code and belongs to that
        if out and (text[a : a + 2] != "//" or not out[0].startswith("//")):
            break
        out.insert(0, text[a:b])
        want = begin - 1
        if text[a : a + 2] != "//":
            break
    return "\n".join(out)
