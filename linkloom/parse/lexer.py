"""Tolerant lexers for Java, C++ and JavaScript: source text to a flat list of tokens, with what is wrong on the way.

A token is (kind, start, end). Kinds: ``w`` word (identifier or keyword), ``n`` number, ``s`` string, character, text
block or regular expression, ``t`` piece of a template literal (from a back quote or closing brace to a back quote or
``${``), ``p`` punctuation, ``c`` comment, ``x`` a character no token of the language starts with, ``u`` an unterminated
literal or comment.
"""

from __future__ import annotations

import re
from functools import cached_property

from ..functions.text import LANGUAGES

SUFFIXES = {suffix: language for language, suffixes in LANGUAGES.items() for suffix in suffixes}

#: Order of encodings tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


def language_of(path: str | None) -> str | None:
    name = (path or "").rpartition("/")[2].lower()
    dot = name.rfind(".")
    return SUFFIXES.get(name[dot:]) if dot >= 0 else None


def decode(content: bytes | None) -> str:
    """Text of a file: the first encoding that fits, without byte-order mark; no content is empty text."""
    if not content:
        return ""
    content = bytes(content)
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return content.decode("utf-16")
        except UnicodeDecodeError:
            pass
    for name in ENCODINGS:
        try:
            text = content.decode(name)
            return text[1:] if text[:1] == "﻿" else text
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


_WORD = r"(?P<w>[^\W\d][\w$]*|\$[\w$]*)"
_NUM = r"(?P<n>\d(?:[eEpP][+-]|['_]?[\w.])*|\.\d(?:[eE][+-]|['_]?[\w.])*)"
_NUM_JAVA = r"(?P<n>0[xX][\w.]*(?:[pP][+-]?\w+)?|\d(?:[eE][+-]|[\w.])*|\.\d(?:[eE][+-]|\w)*)"
_COMMENT = r"(?P<c>//[^\r\n  ]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"
_COMMENT_CPP = r"(?P<c>//(?:[^\\\r\n]|\\\r?\n|\\(?!\r?\n))*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"

JAVA = re.compile(
    r"[ \t\r\n\f\v\x1a]+|" + _COMMENT + "|" + _WORD + "|" + _NUM_JAVA
    + r'|(?P<s>"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\r\n]|\\[^\r\n])*"|""(?!")|\'(?:[^\'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^\r\n])\'|\'[\ud800-\udbff][\udc00-\udfff]\')'
    + r"|(?P<u>\"|'|/\*)"
    + r"|(?P<p>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[(){}\[\];,.@=<>!~?:+\-*/&|^%])"
    + r"|(?P<x>[\s\S])"
)
CPP = re.compile(
    r"(?:[ \t\r\n\f\v]|\\\r?\n)+|" + _COMMENT_CPP
    + r'|(?P<s>(?:u8|[uUL])?R"(?P<raw>[^()\\\s]{0,16})\([\s\S]*?\)(?P=raw)"(?:_\w+)?|(?:u8|[uUL])?"(?:[^"\\\r\n]|\\\r?\n|\\[^\r\n])*"(?:_\w+)?|(?:u8|[uUL])?\'(?:[^\'\\\r\n]|\\[^\r\n])+\'(?:_\w+)?)'
    + r"|(?P<u>(?:u8|[uUL])?R?\"|(?:u8|[uUL])?'|/\*)|" + _WORD + "|" + _NUM
    + r"|(?P<p><=>|<<=|>>=|\.\.\.|->\*|->|::|\.\*|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|##|[(){}\[\];,.=<>!~?:+\-*/&|^%#])"
    + r"|(?P<x>[\s\S])"
)
JS = re.compile(
    r"[\s﻿]+|(?P<html><!--[^\r\n]*)|" + _COMMENT
    + r"|(?P<w>#?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*)|" + r"(?P<n>0[xXoObB][\w]+|\d(?:[eE][+-]|[\w.])*|\.\d(?:[eE][+-]|\w)*)"
    + r"|(?P<s>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"
    + r"|(?P<u>\"|'|/\*)"
    + r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\?|\?\.(?!\d)|\*\*|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|>>|[(){}\[\];,.=<>!~?:+\-*/&|^%@`])"
    + r"|(?P<x>[\s\S])"
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[\w$]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
#: Words after which a slash begins a regular expression.
_JS_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())

Token = tuple[str, int, int]


def lex_java(text: str) -> list[Token]:
    return _until_open(JAVA, text)


def lex_cpp(text: str) -> list[Token]:
    return _until_open(CPP, text)


def _until_open(rx: re.Pattern, text: str) -> list[Token]:
    """Tokens; an unterminated comment swallows the rest, an unterminated string its line."""
    out, pos, n, match = [], 0, len(text), rx.match
    while pos < n:
        m = match(text, pos)
        kind, end = m.lastgroup, m.end()
        if kind:
            if kind == "raw":
                kind = "s"
            if kind == "u":
                if text.startswith("/*", pos):
                    end = n
                else:
                    stop = text.find("\n", end)
                    end = n if stop < 0 else stop
            out.append((kind, pos, end))
        pos = end
    return out


def lex_js(text: str) -> list[Token]:
    out, pos, n, match = [], 0, len(text), JS.match
    braces: list[bool] = []  # of each open brace: whether a template goes on after it
    parens: list[bool] = []  # of each open parenthesis: whether it belongs to if, while, for or with
    after_paren = False
    if text.startswith("#!"):
        pos = len(text.split("\n", 1)[0])
    before = ""  # last significant token
    kind_before = ""

    def template(at: int) -> int:
        """Emit the piece whose first character, a back quote or the brace that ends an inserted expression, is at ``at``."""
        nonlocal before, kind_before
        m = _JS_TEMPLATE.match(text, at + 1)
        if m.group(1) is None:
            out.append(("u", at, n))
            return n
        out.append(("t", at, m.end()))
        if m.group(1) == "${":
            braces.append(True)
            before, kind_before = "{", "p"
        else:
            before, kind_before = "`", "t"
        return m.end()

    while pos < n:
        m = match(text, pos)
        kind, end = m.lastgroup, m.end()
        if not kind:
            pos = end
            continue
        if kind in ("c", "html"):
            out.append(("c", pos, end))
            pos = end
            continue
        if kind == "p":
            sign = text[pos:end]
            if sign[0] == "/":
                ends_operand = kind_before in ("n", "s", "t") or (kind_before == "w" and before not in _JS_BEFORE_REGEX) or before == "]" or (before == ")" and not after_paren)
                r = None if ends_operand else _JS_REGEX.match(text, pos)
                if r:
                    kind, end = "s", r.end()
                    sign = "re"
            if sign == "`":
                pos = template(pos)
                continue
            if sign == "{":
                braces.append(False)
            elif sign == "}":
                if braces and braces.pop():
                    pos = template(pos)
                    continue
            elif sign == "(":
                parens.append(before in ("if", "while", "for", "with") and kind_before == "w")
            elif sign == ")":
                after_paren = parens.pop() if parens else False
        elif kind == "u":
            if text.startswith("/*", pos):
                end = n
            else:
                stop = text.find("\n", end)
                end = n if stop < 0 else stop
        out.append((kind, pos, end))
        before, kind_before = (text[pos:end], kind)
        pos = end
    return out


LEXERS = {"java": lex_java, "cpp": lex_cpp, "javascript": lex_js}


_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\\\n]|\\(?!\r?\n)|\\\r?\n)*)", re.M)
_CONDITIONAL = frozenset(("if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif"))
#: Opaque spans in which a line that starts with # is no directive.
_CPP_OPAQUE = re.compile(
    r'//(?:[^\\\r\n]|\\\r?\n|\\(?!\r?\n))*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|(?:u8|[uUL])?\bR"(?P<raw>[^()\\\s]{0,16})\([\s\S]*?\)(?P=raw)"|"(?:[^"\\\r\n]|\\\r?\n|\\[^\r\n])*"'
    r"|(?<![0-9a-fA-F])'(?:[^'\\\r\n]|\\[^\r\n])+'|(?P<dir>^[ \t]*#[ \t]*(?P<name>\w*)(?P<rest>(?:[^\\\n/]|\\(?!\r?\n)|\\\r?\n|/(?![/*])|/\*[^*\n]*\*/)*))",
    re.M,
)
_DEFINED = re.compile(r"defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")
_INT = re.compile(r"\b(0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)(?:[uUlLzZ]*)\b")


def _truth(expression: str, macros: dict[str, str]) -> bool:
    """Value of a conditional's expression; unknown names are 0, an expression that can't be read is false."""
    e = re.sub(r"/\*.*?\*/|\\\r?\n", " ", expression)
    e = _DEFINED.sub(lambda m: "1" if (m.group(1) or m.group(2)) in macros else "0", e)
    e = re.sub(r"__has_\w+\s*\([^)]*\)", "0", e)
    for _ in range(8):
        new = re.sub(r"[A-Za-z_]\w*(?:\s*\([^()]*\))?", lambda m: (macros.get(re.match(r"\w+", m.group())[0]) or "0") if m.group() not in ("true", "false") else str(int(m.group() == "true")), e)
        new = re.sub(r"(?<=\d)[uUlL]+\b", "", new)
        if new == e:
            break
        e = new
    e = e.replace("&&", " and ").replace("||", " or ")
    e = re.sub(r"!(?!=)", " not ", e).replace("/", "//")
    if not re.fullmatch(r"[\d\sxXa-fA-F()+\-*/%<>=!&|^~andornt]*", e) or not e.strip() or len(e) > 500 or "**" in e:
        return False
    try:
        return bool(eval(e, {"__builtins__": {}}, {}))  # noqa: S307 only digits and operators are left
    except Exception:
        return False


def preprocess(text: str) -> tuple[str, list[str]]:
    """The C++ text as the compiler sees it after its conditional lines, and what is wrong with these.

    Directives and the branches that are not taken become blanks of the same length, so positions stay. Macros that
    the file does not define are unknown; ``__cplusplus`` is known.
    """
    if "#" not in text:
        return text, []
    faults: list[str] = []
    macros: dict[str, str] = {"__cplusplus": "201703"}
    stack: list[list[bool]] = []  # of each open conditional: taken now, taken before, else seen, outer taken
    out: list[str] = []
    at, pos, n, live = 0, 0, len(text), True
    blank = lambda s: re.sub(r"[^\r\n]", " ", s)
    search = _CPP_OPAQUE.search
    while pos < n:
        # in a branch that is not taken only directives and comments matter
        m = search(text, pos) if live else _SKIP.search(text, pos)
        if not m:
            break
        name = m.group("name")
        if m.group("dir") is None:
            pos = m.end()
            continue
        piece = text[at : m.start()]
        out.append(piece if live else blank(piece))
        out.append(blank(m.group()))
        at = pos = m.end()
        rest = m.group("rest").strip()
        if name in ("if", "ifdef", "ifndef"):
            word = re.match(r"\w*", rest)[0]
            value = live and (_truth(rest, macros) if name == "if" else (word in macros) == (name == "ifdef"))
            stack.append([value, value, False, live])
            live = value
        elif name in ("elif", "elifdef", "elifndef", "else"):
            if not stack or stack[-1][2]:
                faults.append("stray #" + name)
                continue
            top = stack[-1]
            word = re.match(r"\w*", rest)[0]
            value = top[3] and not top[1] and (name == "else" or (_truth(rest, macros) if name == "elif" else (word in macros) == (name == "elifdef")))
            top[0], top[1], top[2] = value, top[1] or value, name == "else"
            live = value
        elif name == "endif":
            if not stack:
                faults.append("stray #endif")
                continue
            live = stack.pop()[3]
        elif live and name == "define":
            d = re.match(r"(\w+)(\([^)]*\))?\s*([\s\S]*)", rest)
            if d:
                macros[d.group(1)] = "" if d.group(2) else d.group(3).strip()
        elif live and name == "undef":
            macros.pop(re.match(r"\w*", rest)[0], None)
        elif live and not name and rest:
            faults.append("unknown directive")
        elif live and name not in ("include", "pragma", "error", "warning", "line", "import", "include_next", "ident", "embed", ""):
            faults.append("unknown directive")
    out.append(text[at:] if live else blank(text[at:]))
    if stack:
        faults.append("missing #endif")
    return "".join(out), faults


_SKIP = re.compile(r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|(?P<dir>^[ \t]*#[ \t]*(?P<name>\w*)(?P<rest>(?:[^\\\n/]|\\(?!\r?\n)|\\\r?\n|/(?![/*])|/\*[^*\n]*\*/)*))", re.M)


def tokens(language: str, text: str) -> list[Token]:
    return LEXERS[language](text)


class Unit:
    """A file that is decoded, preprocessed and lexed once for everything that reads it.

    plain: the text as the compiler sees it (C++ after its conditional lines, positions kept), odd: what is wrong with these
    lines, tokens: of ``plain``, comments: those of the tokens that are comments, starts: where the lines start.
    """

    def __init__(self, language: str, text: str) -> None:
        self.language, self.text = language, text
        self.plain, self.odd = preprocess(text) if language == "cpp" else (text, [])
        self.tokens = tokens(language, self.plain)

    @cached_property
    def comments(self) -> list[Token]:
        return [t for t in self.tokens if t[0] == "c"]

    @cached_property
    def starts(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer("\n", self.text)]
