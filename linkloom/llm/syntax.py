"""Source files that do not parse: a lexer per language, a pushdown stack, and rules on neighbouring tokens.

``faults(language, text)`` names what is wrong, an empty list meaning valid. The stack finds unterminated literals and
comments, unbalanced delimiters and premature ends; rules on neighbours find what no statement of the language can
contain: two operands without an operator, an operator without an operand, a statement inside an expression, merge
conflict markers, patch lines, elision marks, and text of another language. The rules know each language's exceptions
(casts, annotations, generics, automatic semicolons, templates, constructors' initializers).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..parse import lexer as L
from ..runtime import spread

_PAIR = {")": "(", "]": "[", "}": "{"}
_MARKS = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")
_CONTROL = frozenset("if for while switch catch with synchronized try foreach".split())
_STATEMENT = frozenset("return if for while do switch try break continue throw case else goto".split())
_J_PRIM = frozenset("int long short byte char float double boolean void".split())
_J_MOD = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
_J_DECL = frozenset("class interface enum import package extends implements throws".split())
_J_KEY = _STATEMENT | _J_PRIM | _J_MOD | _J_DECL | frozenset("new this super null true false instanceof assert finally catch const".split())
_J_TOP = frozenset("package import @ public final abstract class interface enum record sealed non strictfp ; module open private protected static".split())
_J_VALUE = frozenset("this super null true false".split())
_C_TYPE = frozenset("int long short char float double bool void unsigned signed auto const static inline constexpr virtual typename struct class enum union typedef using extern volatile namespace template wchar_t explicit friend mutable".split())
_C_KEY = _STATEMENT | _C_TYPE | frozenset("new delete this nullptr true false sizeof operator public private protected catch noexcept override final throw co_return co_await co_yield default decltype alignas requires static_assert alignof typeid const_cast static_cast dynamic_cast reinterpret_cast".split())
_C_VALUE = frozenset("this nullptr true false".split())
_C_AFTER_PAREN = frozenset("const noexcept override final volatile try requires mutable constexpr throw and or xor not_eq".split())
_C_ATTRIBUTE = frozenset("alignas decltype noexcept __attribute__ __declspec explicit throw requires".split())
_S_KEY = _STATEMENT | frozenset("var let const function class extends new this super null true false typeof instanceof in of delete void await yield async import export from as default finally catch get set static with debugger".split())
_S_STATEMENT = frozenset("return if for while do switch try break continue throw case else var const with debugger export".split())
_S_VALUE = frozenset("this super null true false".split())
#: Contextual words that can be plain names as well.
_S_SOFT = frozenset("let of async from as get set static await yield".split())
_BINARY = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= == != === !== <= >= <=> && || ?? << >>> ** + - * / % & | ^ ? =>".split())
#: Operators after which a name begins an expression, so that no second name can follow it.
_STRICT = frozenset("+ - / % == != <= >= && || = += -= *= /= %= ! ~".split())
_AFTER_BINARY_BAD = frozenset(") ] ; } ,".split())
_NEVER_FIRST = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= == != === !== <= >= && || ?? << >>> % | ^ ? => > ) ] , . ->".split())


def _significant(unit: L.Unit) -> tuple[list[tuple[str, str, int]], list[str]]:
    """(kind, text, start) of the tokens that are no comments; lexical faults."""
    found, text, out = list(unit.odd), unit.plain, []
    for kind, a, b in unit.tokens:
        if kind == "c":
            continue
        if kind == "u":
            found.append("unterminated literal")
        elif kind == "x":
            found.append("stray character")
        out.append((kind, text[a:b], a))
    return out, found


def faults(language: str, text: str, unit: L.Unit | None = None) -> list[str]:
    """What makes the text invalid for the language; empty text and text of comments only are valid.

    unit: the lexed text, where there is one already.
    """
    toks, found = _significant(unit or L.Unit(language, text))
    if not toks or found:
        return found
    return {"java": _java, "cpp": _cpp, "javascript": _javascript}[language](toks, text)


def _line_start(text: str, at: int) -> bool:
    return at == 0 or text[at - 1] in "\r\n"


def _marker(text: str, x: str, at: int) -> bool:
    return x[0] in "<=>|" and _line_start(text, at) and text.startswith(_MARKS, at)


def _java(toks, text: str) -> list[str]:
    stack: list[list] = []  # [opener, what it is]
    bad: list[str] = []
    n = len(toks)
    prev, pk, p2, p2k = "", "", "", ""  # previous token and kind, and the one before
    header: set[str] = set()  # keywords of the statement so far
    annotated = False  # prev ends an annotation's name
    closed = ""  # what the last closed parenthesis was
    tried = False  # the block of a try has just ended
    start = True  # at the start of a statement
    for i in range(n):
        k, x, at = toks[i]
        word = k == "w"
        key = word and x in _J_KEY
        name = word and not key
        if _marker(text, x, at):
            return ["merge conflict"]
        if word and x in ("const", "goto"):
            return ["foreign word"]
        if not stack and start and not (x in _J_TOP or x == "}"):
            return ["no declaration"]
        if pk in ("n", "s"):
            if k in ("n", "s") or (word and x not in ("instanceof",) and not (p2 == "case" and x == "when")) or x in ("(", "{") and not (x == "{" and closed == "control"):
                return ["operand after literal"]
        elif pk == "w" and (prev not in _J_KEY or prev in _J_VALUE):
            if k in ("n", "s"):
                return ["literal after operand"]
            if key and not annotated and (x in _STATEMENT or x in _J_PRIM or x in _J_MOD or x in ("class", "interface", "enum", "import", "package", "new") or x in _J_VALUE) and not (prev in ("sealed", "open", "record") or x == "default" or (x == "static" and p2 == "import")):
                return ["statement after operand"]
            if name and not annotated:
                if p2k == "w" and p2 not in _J_KEY and not (p2 in ("record", "sealed", "permits", "module", "var", "exports", "requires", "opens", "provides", "to", "with", "uses", "transitive") or prev in ("permits", "record", "when", "to", "with")):
                    return ["three names"]
                if p2 == "::":
                    return ["name after reference"]
                if p2 in _STRICT or p2 == "<":
                    return ["two names in expression"]
        elif prev == ")":
            if k in ("n", "s") and closed not in ("group", "control"):
                return ["literal after call"]
            if name and closed == "call" and x != "when":
                return ["name after call"]
            if key and closed == "call" and x not in ("throws", "instanceof", "default", "implements"):
                return ["statement after call"]
            if key and closed == "group" and (x in _STATEMENT and x != "switch" or x in _J_MOD or x in _J_DECL):
                return ["statement after group"]
        elif prev == "]":
            if k in ("n", "s") or (key and x not in ("instanceof", "throws", "default", "implements", "permits")):
                return ["operand after bracket"]
        elif prev in _BINARY:
            if prev == "?" and p2 in ("<", ","):
                if not (x in (">", ",", ">>", "&", ">>>") or x in ("extends", "super")):
                    return ["wildcard"]
            elif prev == "*" and p2 == ".":
                pass
            elif prev == "&" and word:
                pass
            elif x in _AFTER_BINARY_BAD or (x in _BINARY and x not in ("+", "-", "?")):
                return ["operator without operand"]
            elif key and (x in _STATEMENT and x != "switch" or x in _J_MOD or x in _J_DECL):
                return ["statement in expression"]
            elif key and x in _J_PRIM and (i + 1 >= n or toks[i + 1][1] not in (".", "[", "::")):
                return ["declaration in expression"]
        elif prev == ".":
            if not (word and (name or x in ("new", "this", "super", "class")) or x in ("<", "*", "@")):
                return ["member"]
        elif prev == "...":
            if not (name or x == "this"):
                return ["elision"]
        elif prev in (";", "{", "}", ""):
            if x in _NEVER_FIRST and not (prev in ("{", "}") and x in (",", ")", ".", "]") and (prev == "}" or x == ",")):
                if not (prev == "}" and x in ("?", "==", "!=")):
                    return ["operator first"]
            if x in ("+", "-") and prev != "{" or x == "[" or x == "..." or x == "/" or (x == "*"):
                return ["operator first"]
            if prev == "}" and k in ("n", "s"):
                return ["literal first"]
            if prev in (";",) and k == "n":
                return ["literal first"]
        elif prev == "," or prev == "(":
            if key and (x in _STATEMENT and x != "switch" or x in _J_DECL or x in ("public", "private", "protected", "static")):
                return ["statement in list"]
            if x in (";",) and prev == "," or x == "," or (x in _BINARY and x not in ("+", "-", "?")) or (x == ")" and prev == ","):
                return ["empty item"]
            if x == ";" and prev == "(" and p2 != "for":
                return ["empty item"]
        elif pk == "w" and prev in _STATEMENT:
            if prev in ("if", "while", "for", "switch") and x != "(":
                return ["no condition"]
            if prev == "try" and x not in ("{", "("):
                return ["no block"]
        if x == "else" and prev not in (";", "}") or x in ("finally", "catch") and word and prev != "}":
            return ["stray " + x]
        if tried and x not in ("catch", "finally"):
            return ["try alone"]
        tried = False
        annotated_next = False
        if k == "p":
            if x in "([{":
                if x == "(":
                    what = "control" if pk == "w" and prev in _CONTROL else "annotation" if annotated else "call" if (pk == "w" and (prev not in _J_KEY or prev in ("this", "super"))) or prev in (")", "]", ">") else "group"
                    stack.append(["(", what, prev])
                elif x == "[":
                    stack.append(["[", "", prev])
                else:
                    array = prev in ("=", "]", ",") or (prev == "(" and stack and stack[-1][1] == "annotation") or (prev == "{" and stack and stack[-1][1] == "array")
                    what = "array" if array else "enum" if "enum" in header else "class" if header & {"class", "interface", "record"} or (closed == "call" and prev == ")" and "new" in header) else "block"
                    if what == "block" and stack and stack[-1][1] == "class" and prev in ("->",):
                        what = "block"
                    stack.append(["{", what, prev])
            elif x in ")]}":
                if not stack or stack[-1][0] != _PAIR[x]:
                    return ["unbalanced " + x]
                top = stack.pop()
                if x == ")":
                    closed = top[1]
                    if top[1] == "annotation":
                        annotated_next = True
                elif x == "}" and top[1] in ("block", "class") and prev not in (";", "{", "}"):
                    return ["no end of statement"]
                if x == "}":
                    tried = top[2] == "try"
            elif x == ";" and stack and (stack[-1][0] == "[" or (stack[-1][0] == "(" and stack[-1][2] not in ("for", "try"))):
                return ["unbalanced ("]
            elif x == "@":
                if i + 1 >= n or toks[i + 1][0] != "w":
                    return ["stray @"]
        elif word:
            if prev == "@" or (prev == "." and annotated_before):
                annotated_next = x != "interface"
            if stack and stack[-1][1] == "class" and start and (x in _STATEMENT or x in ("this", "super") or (name and _acts(toks, i))):
                return ["statement in class"]
        if x == "." and annotated:
            annotated_before = True
        elif not word:
            annotated_before = False
        annotated = annotated_next
        new_start = x in (";", "{", "}") and k == "p" and not (x == "}" and stack and stack[-1][0] == "(")
        if new_start:
            header = set()
        elif key and x in ("class", "interface", "enum", "new") and not (x == "class" and prev == "."):
            header.add(x)
        elif name and x == "record" and (start or prev in _J_MOD):
            header.add(x)
        start = new_start
        p2, p2k, prev, pk = prev, pk, x, k
    if stack or tried:
        return ["premature end"]
    if prev not in (";", "}"):
        return ["premature end"]
    return bad


def _acts(toks, i: int) -> bool:
    """Whether the statement that begins with the name at ``i`` assigns or calls rather than declares."""
    n = len(toks)
    after = toks[i + 1][1] if i + 1 < n else ""
    if after in ("=", "+=", "-=", "*=", "/=", "++", "--"):
        return True
    while after == "." and i + 3 < n and toks[i + 2][0] == "w":
        i += 2
        after = toks[i + 1][1]
        if after == "(":
            return True
    if after != "(":
        return False
    depth = 0
    for j in range(i + 1, n):
        if toks[j][0] == "p":
            depth += (toks[j][1] == "(") - (toks[j][1] == ")")
            if depth == 0:
                return j + 1 < n and toks[j + 1][1] in (";", ".", "=")
    return False


def _cpp(toks, text: str) -> list[str]:
    stack: list[list] = []
    n = len(toks)
    prev, pk, p2, p2k = "", "", "", ""
    header: set[str] = set()
    closed, closed_brace = "", ""
    start, tried = True, False
    for i in range(n):
        k, x, at = toks[i]
        word = k == "w"
        key = word and x in _C_KEY
        name = word and not key
        if _marker(text, x, at):
            return ["merge conflict"]
        if pk == "n":
            if k in ("n", "s") or (word and x not in ("and", "or", "xor", "not_eq")) or x in ("(", "{", "["):
                return ["operand after literal"]
        elif pk == "s":
            if k == "n" or (word and not (p2 in ("extern", "operator") or x.isupper() or x in ("and", "or") or x[:3] in ("PRI", "SCN"))):
                return ["operand after literal"]
        elif pk == "w" and (prev not in _C_KEY or prev in _C_VALUE):
            if k == "n" or (k == "s" and not (prev.isupper() or prev[:3] == "PRI" or prev in ("asm", "_Pragma", "__asm__"))):
                return ["literal after operand"]
            if key and not prev.isupper() and (x in _STATEMENT or x in ("public", "private", "protected", "namespace", "using", "typedef", "template", "struct", "class", "enum", "int", "long", "short", "char", "float", "double", "bool", "void", "auto", "static", "inline", "virtual", "new", "delete") or x in _C_VALUE) and not (p2 == "[[") and prev not in ("export", "module", "and", "or", "not"):
                return ["statement after operand"]
            if name and (p2 in _STRICT or (p2 == "<" and i + 1 < n and toks[i + 1][1] in ("++", "--"))) and not prev.isupper() and not x.isupper() and not {prev, x} & {"and", "or", "not", "xor", "final", "override"}:
                return ["two names in expression"]
            if name and p2k == "w" and p2 not in _C_KEY and not (p2.isupper() and not prev.isupper()) and not x.isupper() and not {p2, prev, x} & {"and", "or", "not", "final", "override", "export", "import", "module", "concept", "noexcept"}:
                return ["three names"]
        elif prev == ")":
            if k == "n" and closed not in ("group", "control"):
                return ["literal after call"]
            if name and closed == "call" and not (x.isupper() or x in ("and", "or", "not_eq", "xor", "override", "final", "noexcept", "asm", "__attribute__")):
                return ["name after call"]
            if key and closed == "call" and not (x in _C_AFTER_PAREN or (x == "default")):
                return ["statement after call"]
            if key and closed == "group" and (x in _STATEMENT or x in ("public", "private", "protected", "namespace", "template", "typedef")):
                return ["statement after group"]
        elif prev == "]":
            if k in ("n",) or (key and (x in _STATEMENT) and p2 != "]"):
                return ["operand after bracket"]
        elif prev in _BINARY:
            if prev in ("*", "&", "&&") and (x in (")", ",", ">", "]", "&", "*", "&&", "const", "...", "=", ";") or word):
                if key and x in _STATEMENT:
                    return ["statement in expression"]
            elif prev == "=" and x in ("]", ";", ")", "}", ",") and not (p2 == "[" or x == "]") and p2 != "operator":
                return ["operator without operand"]
            elif p2 == "operator" or prev == "=" or prev == "?":
                if key and x in _STATEMENT and not (prev == "?" and x == "throw"):
                    return ["statement in expression"]
                if prev == "=" and key and x in ("int", "long", "char", "void", "bool", "double", "float", "auto", "const") and (i + 1 >= n or toks[i + 1][1] not in ("(", "{", "*", ">")) and "using" not in header and "typename" not in header and "template" not in header:
                    return ["declaration in expression"]
                if prev == "=" and x in _BINARY and x not in ("+", "-", "*", "&", "&&"):
                    return ["operator without operand"]
            elif x in _AFTER_BINARY_BAD:
                return ["operator without operand"]
            elif x in _BINARY and x not in ("+", "-", "*", "&", "&&"):
                return ["operator without operand"]
            elif key and (x in _STATEMENT or x in ("public", "private", "protected", "namespace", "template", "typedef", "using", "static", "int", "bool", "double", "float", "auto", "void") and (i + 1 >= n or toks[i + 1][1] not in ("(", "{"))):
                return ["statement in expression"]
        elif prev in (".", "->"):
            if not (word or x in ("*", "~", "...")) and not (prev == "." and p2 in ("{", ",")):
                return ["member"]
        elif prev in (";", "{", "}", ""):
            if x in _NEVER_FIRST and not ((prev == "}" and x in (",", ")", ".", "]", "->", "=", "==", "!=", "?", ">", "||")) or (prev == "{" and x in (".", ","))):
                return ["operator first"]
            if x in ("+", "-", "/") and prev != "{" or (x == "<") or x == "..." and prev != "}" or (x == "[" and prev != "" and (i + 1 >= n or not (toks[i + 1][1] == "[" or toks[i + 1][1] in ("]", "&", "=", "this", ",") or toks[i + 1][0] == "w"))):
                return ["operator first"]
            if prev == "}" and x == "..." and (i + 1 >= n or toks[i + 1][1] not in (",", ")", "}", ">")):
                return ["elision"]
            if prev != "{" and k in ("n",):
                return ["literal first"]
            if prev == "}" and closed_brace == "type" and not (x == ";" or word and not key or x in ("*", "&", ",", "[", "__attribute__")):
                return ["no end of type"]
        elif prev == "," or prev == "(":
            if key and (x in _STATEMENT and x != "throw" or x in ("public", "private", "protected", "namespace")):
                if not (prev == "," and x in ("public", "private", "protected") and header & {"class", "struct"}):
                    return ["statement in list"]
            if (x == ";" and not (prev == "(" and p2 == "for")) or x == "," or (x in _BINARY and x not in ("+", "-", "*", "&", "=", "&&", "^") and not (prev == "(" and i + 1 < n and toks[i + 1][1] in (")", "..."))) or (x == ")" and prev == ","):
                return ["empty item"]
        elif prev == "...":
            if k in ("n",) or (x == "]" and p2 not in ("this",) and p2k != "w" and p2 not in (",", "[")):
                return ["elision"]
            if x == "(" and p2 in (";", "{", "}"):
                return ["elision"]
        elif pk == "w" and prev in ("if", "while", "for", "switch"):
            if x != "(" and not (prev == "if" and x in ("constexpr", "consteval", "!")):
                return ["no condition"]
        elif pk == "w" and prev in ("public", "private", "protected"):
            if x != ":" and not (p2 in (":", ",", "virtual")):
                return ["foreign word"]
        if x == "else" and prev not in (";", "}") or x == "catch" and word and prev != "}":
            return ["stray " + x]
        if tried and x != "catch":
            return ["try alone"]
        tried = False
        if start and (not stack or stack[-1][1] in ("space", "type")) and (key and x in _STATEMENT or name and i + 1 < n and toks[i + 1][1] in (".", "->", "=", "+=", "-=", "++", "--")):
            return ["statement outside a function"]
        if k == "p":
            if x in "([{":
                if x == "(":
                    what = "control" if pk == "w" and prev in _CONTROL or (prev == "constexpr" and p2 == "if") else "attribute" if pk == "w" and prev in _C_ATTRIBUTE else "call" if (pk == "w" and (prev not in _C_KEY or prev in ("this", "operator"))) or prev in (")", "]", ">") or p2 == "operator" else "group"
                    stack.append(["(", what, prev])
                elif x == "[":
                    stack.append(["[", "", prev])
                else:
                    inside = stack[-1][1] if stack else ""
                    if header & {"class", "struct", "union"} and "(" not in header and "=" not in header:
                        what = "type"
                    elif "enum" in header and "(" not in header:
                        what = "enum"
                    elif prev in ("=", ",", "(", "return", "[", ">", "]", ":", "?") or (pk == "w" and prev not in _C_KEY and not header & {"namespace", "try", "extern"} and prev not in ("override", "final", "noexcept") and ("ctor" in header or ")" not in header)) or (inside == "list" and prev == "{"):
                        what = "list"
                    elif "namespace" in header or ("extern" in header and pk == "s"):
                        what = "space"
                    else:
                        what = "block"
                    stack.append(["{", what, prev])
            elif x in ")]}":
                if not stack or stack[-1][0] != _PAIR[x]:
                    return ["unbalanced " + x]
                top = stack.pop()
                if x == ")":
                    closed = top[1]
                elif x == "}":
                    closed_brace, tried = top[1], top[2] == "try"
                    if top[1] in ("block", "type", "space") and prev not in (";", "{", "}", ":") and not (pk == "w" and prev.isupper()) and not (prev == ")" and toks[i - 1][1] == ")" and _macro(toks, i - 1)):
                        return ["no end of statement"]
            elif x == ";" and stack and (stack[-1][0] == "[" or (stack[-1][0] == "(" and stack[-1][2] not in ("for", "if", "switch", "constexpr", "while"))):
                return ["unbalanced ("]
            elif x == "#":
                return ["stray #"]
        ends = x in (";", "{", "}") and k == "p" and not (stack and stack[-1][0] == "(")
        if ends or (x == ":" and prev in ("public", "private", "protected")):
            header = set()
            start = True
        else:
            if word and x in ("class", "struct", "union", "enum", "namespace", "try", "extern", "using", "typename", "template") and not (stack and stack[-1][0] == "(") and prev not in ("<", ",", "friend") and not (x == "class" and prev == "enum"):
                header.add(x)
            elif x == ":" and (prev == ")" or prev == "noexcept") and not (stack and stack[-1][0] == "("):
                header.add("ctor")
            elif x in ("(", "=", ")") and not (stack and x == "(" and len(stack) > 1 and stack[-2][0] == "("):
                header.add(x)
            start = False
        p2, p2k, prev, pk = prev, pk, x, k
    if stack or tried:
        return ["premature end"]
    if prev not in (";", "}") and not (prev == ")" and _macro(toks, n - 1)) and not (pk == "w" and prev.isupper()):
        return ["premature end"]
    if prev == "}" and closed_brace == "type":
        return ["no end of type"]
    return []


def _macro(toks, close: int) -> bool:
    """Whether the parenthesis closed at ``close`` follows a name in capitals, hence an unknown macro."""
    depth = 0
    for j in range(close, -1, -1):
        x = toks[j][1]
        if toks[j][0] == "p":
            depth += (x == ")") - (x == "(")
            if depth == 0:
                return j > 0 and toks[j - 1][0] == "w" and toks[j - 1][1].isupper()
    return False


def _javascript(toks, text: str) -> list[str]:
    stack: list[list] = []
    n = len(toks)
    prev, pk, p2, p2k, pend = "", "", "", "", 0
    closed, closed_brace, tried = "", "", False
    header: set[str] = set()
    for i in range(n):
        k, x, at = toks[i]
        word = k == "w"
        soft = word and x in _S_SOFT
        key = word and x in _S_KEY and not soft
        name = word and not key
        if _marker(text, x, at):
            return ["merge conflict"]
        fresh_line = "\n" in text[pend:at] or "\r" in text[pend:at] if at > pend else False
        operand_before = pk in ("n", "s") or (pk == "t" and prev[-1] == "`") or (pk == "w" and prev not in _S_KEY) or prev in _S_VALUE or prev == "]" or (prev == ")" and closed != "control")
        dotted = p2 in (".", "?.")
        if dotted and pk == "w":
            operand_before = True
        opens_operand = k in ("n", "s") or (name and not soft) or (key and (x in _S_VALUE or x in ("new", "typeof", "function", "class", "delete", "void")))
        if operand_before and not fresh_line:
            if opens_operand and not (pk == "w" and prev in _S_SOFT and not dotted) and not (x in ("assert", "with") and pk == "s"):
                return ["operand after operand"]
            if key and x in _S_STATEMENT and not (stack and stack[-1][1] == "object"):
                return ["statement after operand"]
            if x == "{" and pk in ("n", "s"):
                return ["block after literal"]
        if prev in ("++", "--") and (p2k in ("n",) or (p2k == "w" and p2 not in _S_KEY)) and not fresh_line and opens_operand and text[pend - 3] not in " \n\t":
            return ["operand after operand"]
        if prev in ("++", "--") and p2k == "w" and p2 not in _S_KEY and not fresh_line and opens_operand and text[pend - 3] in " \t":
            return ["operand after operand"]
        if pk == "p":
            if prev in _BINARY or prev in ("~", "!"):
                if prev == "*" and (p2 in ("function", "yield", "export", "async", "static", ",", "{", "}", ";") or p2k == "w" and p2 in ("get", "set") or p2 == "import"):
                    pass
                elif x in _AFTER_BINARY_BAD:
                    return ["operator without operand"]
                elif x in _BINARY and x not in ("+", "-"):
                    return ["operator without operand"]
                elif key and x in _S_STATEMENT or (word and x == "import" and (i + 1 >= n or toks[i + 1][1] not in ("(", "."))) or (word and x == "let" and i + 1 < n and toks[i + 1][0] == "w"):
                    return ["statement in expression"]
                elif prev in ("+", "-") and p2 in ("", ";", "{", "}") and word and x in ("function", "class", "static", "async", "constructor", "get", "set") and prev == "-":
                    return ["patch line"]
            elif prev in (".", "?."):
                if not word and x not in ("(", "[") and not (prev == "?." and k == "t"):
                    return ["member"]
                if prev == "." and x in ("(", "["):
                    return ["member"]
            elif prev in (";", "{", ""):
                if x in _NEVER_FIRST and not (prev == "{" and x in ("}",)) and not (prev == "" and x == "<!--"):
                    if not (prev == ";" and x in (")",) and stack and stack[-1][2] == "for"):
                        return ["operator first"]
                if x in ("<", "*") and not (prev == "{" and x == "*") and not (x == "*" and stack and stack[-1][1] == "class"):
                    return ["operator first"]
                if x == "..." and not (prev == "{" and stack and stack[-1][1] == "object"):
                    return ["elision"]
            elif prev == "}":
                if x == "..." or (x in ("<",) and fresh_line):
                    return ["operator first"]
                if x == "*" and not (stack and stack[-1][1] == "class") and fresh_line:
                    return ["operator first"]
                if fresh_line and closed_brace in ("block", "class") and x in _NEVER_FIRST and x not in (")", "]", ",", ".", "="):
                    return ["operator first"]
            elif prev == "," or prev == "(":
                if key and x in _S_STATEMENT and not (prev == "(" and p2 == "for" and x in ("var", "const")) and not (stack and stack[-1][1] == "object"):
                    return ["statement in list"]
                if (x == "," and prev == "(") or (x == ";" and not (prev == "(" and p2 in ("for", "await"))) or (x in _BINARY and x not in ("+", "-", "*")):
                    return ["empty item"]
            elif prev == "...":
                if not (word or x in ("[", "{", "(") or k in ("t", "s")):
                    return ["elision"]
            elif prev == "@":
                if not word and x != "(":
                    return ["stray @"]
        elif pk == "w" and not dotted and not (stack and stack[-1][1] in ("object", "class") and x in ("(", ":", ",", "=", ";", "}")):
            if prev in ("if", "while", "for", "switch", "with") and x != "(" and not (prev == "for" and x == "await"):
                return ["no condition"]
            if prev in ("var", "const") and not (word or x in ("{", "[")):
                return ["no name"]
            if prev in ("let", "const", "var") and word and i + 1 < n and toks[i + 1][0] in ("w", "n", "s") and toks[i + 1][1] not in ("of", "in") and "\n" not in text[at : toks[i + 1][2]]:
                return ["operand after operand"]
            if prev in ("function", "class") and k in ("n", "s"):
                return ["no name"]
            if prev == "return" and not fresh_line and key and x in _S_STATEMENT:
                return ["statement in expression"]
        if word and x[0] == "#" and not (prev in (".", "?.") or (i + 1 < n and toks[i + 1][1] == "in") or (stack and stack[-1][1] == "class")):
            return ["stray #"]
        if key and x == "else" and prev not in (";", "}") and not fresh_line and not (stack and stack[-1][1] in ("object", "class")) and prev not in (".", "?."):
            return ["stray else"]
        if key and x in ("catch", "finally") and prev not in ("}", ".", "?.") and not (stack and stack[-1][1] in ("object", "class")):
            return ["stray " + x]
        if tried and x not in ("catch", "finally"):
            return ["try alone"]
        tried = False
        if key and x == "return" and not dotted and prev not in (".", "?.") and not (stack and stack[-1][1] in ("object", "class")) and not any(f[0] == "{" and f[-1] is True for f in stack):
            return ["statement outside a function"]
        if key and stack and stack[-1][1] == "class" and prev in (";", "{", "}") and i + 3 < n:
            after = toks[i + 1][1]
            if x in ("return", "const", "var", "throw", "try") and after not in ("(", "=", ";", "}") or x in ("if", "for", "while", "switch") and after == "(" and toks[i + 2][1] != ")" and toks[i + 2][1] not in ("{", "[", "...") and toks[i + 3][1] not in (",", ")", "="):
                return ["statement in class"]
        if k == "t":
            if x[0] == "}":
                if not stack or stack[-1][0] != "${":
                    return ["unbalanced }"]
                stack.pop()
            if x.endswith("${"):
                stack.append(["${", "", ""])
        elif k == "p":
            if x in "([{":
                if x == "(":
                    control = pk == "w" and not dotted and (prev in _CONTROL or (prev == "await" and p2 == "for")) and not (stack and stack[-1][1] in ("class", "object") and prev not in ("if", "for", "while", "switch"))
                    stack.append(["(", "control" if control else "call" if pk == "w" or prev in (")", "]") else "group", "for" if prev in ("for", "await") else prev, "function" in header])
                elif x == "[":
                    stack.append(["[", "", prev])
                else:
                    if "class" in header:
                        what = "class"
                        header.discard("class")
                    elif prev in ("", ";", "{", "}", ")", "=>", ":") and not (prev == ":" and stack and stack[-1][1] == "object") and not (prev in ("{", "}") and stack and stack[-1][1] == "object") or (pk == "w" and not dotted and prev in ("else", "do", "try", "finally", "static", "catch")):
                        what = "block"
                        if prev == ":" and not (p2k == "w" and stack and stack[-1][1] == "block") and not "case" in header and p2 != "default":
                            what = "object"
                    else:
                        what = "object"
                    if what == "block" and i + 2 < n and toks[i + 1][0] in ("s", "n") and toks[i + 2][1] == ":" and prev in ("", ";", "{", "}"):
                        return ["data, not code"]
                    stack.append(["{", what, prev, prev == "=>" or (prev == ")" and closed != "control")])
            elif x in ")]}":
                if not stack or stack[-1][0] != _PAIR[x]:
                    return ["unbalanced " + x]
                top = stack.pop()
                if x == ")":
                    closed = top[1]
                elif x == "}":
                    closed_brace, tried = top[1], top[2] == "try" and top[1] == "block"
            elif x == ";":
                if stack and (stack[-1][0] in ("[", "${") or (stack[-1][0] == "(" and stack[-1][2] != "for") or stack[-1][1] == "object"):
                    return ["unbalanced ("]
        if x in (";", "{", "}") and k == "p":
            header = set()
        elif word and x in ("class", "case", "function") and prev not in (".", "?.") and not (stack and stack[-1][1] == "object" and i + 1 < n and toks[i + 1][1] == ":"):
            header.add(x)
        p2, p2k, prev, pk, pend = prev, pk, x, k, at + len(x)
    if stack or tried:
        return ["premature end"]
    if pk == "p" and (prev in _BINARY or prev in (",", ".", "(", "=>")) or (pk == "w" and p2 not in (".", "?.") and prev in ("if", "for", "while", "function", "class", "new", "const", "var", "export", "import", "typeof", "extends", "case", "throw", "else", "do", "try")):
        return ["premature end"]
    return []


#: Suffixes that count as JavaScript elsewhere but hold other grammars: types and markup would be judged by the wrong rules.
OTHER_GRAMMARS = (".ts", ".tsx", ".jsx")


def judged_as(path: str | None) -> str | None:
    """The language by whose rules a file is judged; null for unknown suffixes and those of other grammars."""
    return None if (path or "").lower().endswith(OTHER_GRAMMARS) else L.language_of(path)


CHECKED = "path string, repo string, language string, fault string"


def checked(files: DataFrame) -> DataFrame:
    """(path, repo, language, fault) of each row: the first fault found, null for a valid file.

    Rows whose path is null or has no suffix of the three languages, or one of ``OTHER_GRAMMARS``, are left out; null and
    empty contents are valid.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, repo, content in part[["path", "repo", "content"]].itertuples(index=False, name=None):
                language = judged_as(path)
                if language is not None:
                    found = faults(language, L.decode(content))
                    rows.append((path, repo, language, found[0] if found else None))
            yield pd.DataFrame(rows, columns=["path", "repo", "language", "fault"])

    return spread(files.select("path", "repo", "content")).mapInPandas(run, CHECKED)


def unparsable(files: DataFrame) -> DataFrame:
    """(path) of files that are not valid in the language of their suffix; repeated scans count once."""
    return checked(files).where("fault is not null").select("path").distinct()


def fault_rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, faulty, share): distinct paths and the share of those that do not parse."""
    each = checked(files).groupBy("path").agg(F.max("repo").alias("repo"), F.max("language").alias("language"), F.max(F.col("fault").isNotNull()).alias("bad"))
    counts = each.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("bad").alias("faulty"))
    return counts.withColumn("share", F.round(F.col("faulty") / F.col("files"), 6))
