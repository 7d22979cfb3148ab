"""Lexers of six languages: adjacent pairs of token classes, and the bracket events of a text.

Each lexer returns (pairs, nest, keys): the distinct pairs of adjacent classes (``^`` starts and ``$`` ends a text), the
events of nesting in order, positive for an opening and negative for a closing one of a kind, and names that a text may
give once only. Lexers judge nothing: what they can't name is a token spelled as it stands, a quote that isn't closed is an
opening event, a line at a depth where nothing is open closes what was never opened. Some classes tell places apart that
a pair can't see (``,O`` in an object, ``;(`` in round brackets, ``return^`` outside functions).
"""

from __future__ import annotations

import re

# Kinds of brackets and of the sections of compound commands.
ROUND, SQUARE, CURLY, THEN, COND, DO, LOOP, CASE_HEAD, CASE_BODY, INTERP, QUOTE, TERNARY, LAMBDA, TEST, PATTERN = range(1, 16)
#: Levels of indentation are kinds from here on.
LEVEL = 1000
_OPEN = {"(": ROUND, "[": SQUARE, "{": CURLY}
_CLOSE = {")": ROUND, "]": SQUARE, "}": CURLY}


class Trace:
    """Collects pairs and bracket events while a lexer runs."""

    __slots__ = ("pairs", "nest", "keys", "prev")

    def __init__(self) -> None:
        self.pairs: set[tuple[str, str]] = set()
        self.nest: list[int] = []
        self.keys: list[str] = []
        self.prev = "^"

    def add(self, cls: str) -> None:
        self.pairs.add((self.prev, cls))
        self.prev = cls

    def end(self) -> tuple[set[tuple[str, str]], list[int], list[str]]:
        self.add("$")
        return self.pairs, self.nest, self.keys


_JSON = re.compile(r'[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<lit>(?:true|false|null)(?!\w))|(?P<p>[\[\]{},:])|(?P<word>[\w.+-]+|//|/\*)|(?P<open>["\x27])|(?P<other>[^ \t\r\n]))', re.S)


def json_tokens(text: str) -> tuple[set, list, list]:
    """JSON without extensions."""
    t, stack = Trace(), []
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind == "str":
            t.add("KEY" if stack and stack[-1] == CURLY and t.prev in ("{", ",O") else "STR")
        elif kind == "p":
            c = m[kind]
            if c in _OPEN:
                stack.append(_OPEN[c])
                t.nest.append(_OPEN[c])
                t.add(c)
            elif c in _CLOSE:
                t.nest.append(-_CLOSE[c])
                if stack:
                    stack.pop()
                t.add(c)
            else:
                t.add(c if c == ":" else ",O" if stack and stack[-1] == CURLY else ",A")
        else:
            if kind == "open":
                t.nest.append(QUOTE)
            t.add({"num": "NUM", "lit": "LIT", "word": "WORD", "open": "STR"}.get(kind) or m[kind])
    return t.end()


_ESCAPE = r'\\(?:["\\bfnrt]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})'
_TOML = re.compile(
    r'[ \t]+|(?P<nl>\r?\n)|(?P<c>#[^\r\n\x00-\x08\x0b-\x1f\x7f]*)'
    r'|(?P<str>"""(?:[^\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|' + _ESCAPE + r'|\\[ \t]*\r?\n)*?"""{1,3}(?!")|\'\'\'[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*?\'\'\'{1,3}(?!\')'
    r'|"(?!"")(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|' + _ESCAPE + r')*"|\'(?!\'\')[^\'\x00-\x08\x0a-\x1f\x7f]*\')'
    r'|(?P<p>[\[\]{},=])|(?P<w>[A-Za-z0-9_+\-:.]+(?:[ ](?=\d\d:)[\dZz:.+-]+)?)|(?P<bad>.)', re.S
)
_DIGITS = r"\d(?:_?\d)*"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_TOML_VALUE = re.compile(
    rf"[+-]?(?:inf|nan)|true|false|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.{_DIGITS})?(?:[eE][+-]?{_DIGITS})?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    rf"|\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}"
)


def toml_tokens(text: str) -> tuple[set, list, list]:
    """TOML 1.0; keys and headers are names that may be given once."""
    t, stack, header, key, path = Trace(), [], False, True, ""
    tables: dict[str, str] = {}  # of each array of tables its present one

    def whole(names: list[str]) -> str:
        at = ""
        for n in names:
            at = f"{at}.{n}" if at else n
            at = tables.get(at, at)
        return at

    line_key: list[str] = []
    for m in _TOML.finditer(text):
        kind = m.lastgroup
        if kind in (None, "c"):
            continue
        v = m[0]
        if kind == "nl":
            if not stack:
                key, line_key = True, []
            t.add("NLO" if stack and stack[-1] == CURLY else "NL")
        elif kind == "p":
            if v == "[" and key and not stack and not header:
                double = text.startswith("[[", m.start())
                header = True
                t.add("[H")
                t.nest.append(SQUARE)
                several = double
            elif v == "[" and header and t.prev == "[H":
                t.nest.append(SQUARE)
            elif v == "]" and header:
                t.nest.append(-SQUARE)
                if t.prev != "]H":
                    if several:
                        outer = whole(line_key[:-1])
                        name = f"{outer}.{line_key[-1]}" if outer else "".join(line_key[-1:])
                        tables[name] = path = f"{name}#{m.start()}"
                    else:
                        path = whole(line_key)
                    t.keys.append(path)
                    t.add("]H")
                if not text.startswith("]", m.end()):
                    header = False
                    key = False
            elif v in "[{":
                stack.append(_OPEN[v])
                t.nest.append(_OPEN[v])
                t.add(v)
                key = v == "{"
            elif v in "]}":
                t.nest.append(-_CLOSE[v])
                if stack:
                    stack.pop()
                t.add(v)
            elif v == ",":
                inner = stack and stack[-1] == CURLY
                t.add(",O" if inner else ",A" if stack else ",")
                key = bool(inner)
            else:
                if not stack and key:
                    t.keys.append(".".join([path, *line_key] if path else line_key))
                t.add("=")
                key = False
        elif kind in ("str", "w") and key:
            for i, part in enumerate([v.strip("\"'")] if kind == "str" else v.split(".")):
                if i:
                    t.add(".K")
                if kind == "str":
                    t.add("STR3" if v.startswith(('"""', "'''")) else "K")
                elif part:
                    t.add("WORD" if re.search(r"[+:]", part) else "K")
                line_key.append(part)
        elif kind == "str":
            t.add("STR3" if v.startswith(('"""', "'''")) else "STR")
        elif kind == "w":
            t.add("NUM" if _TOML_VALUE.fullmatch(v) else "WORD")
        elif v in "\"'":
            t.nest.append(QUOTE)
            t.add("STR")
        else:
            t.add(v)
    return t.end()


_YKEY = re.compile(r"""(?P<k>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},?:-][^#]*?|[-?:](?=\S)[^#]*?)\s*:(?=\s|$)(?P<v>.*)""")
_YSCALAR = re.compile(r"""\s*(?:(?:[&!][^\s]*)\s+)*(?:(?P<q>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:\s\#.*)?$|(?P<flow>[\[{])|(?P<block>[|>][+-]?\d?[+-]?)\s*(?:\#.*)?$|(?P<alias>\*[^\s]+)\s*(?:\#.*)?$|(?P<none>(?:[&!]\S*)?\s*(?:\#.*)?)$|(?P<plain>[^\s"'\[\]{}#&*!|>%@`,].*)$)""", re.S)


_YQUOTED = re.compile(r"""(?:"(?:[^"\\]|\\.)*+"|'(?:[^']|'')*+')""")
_YFLOW = re.compile(r"""(?P<q>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|(?P<o>[\[{])|(?P<x>[\]}])|(?P<c>(?:^|\s)\#.*)|(?P<b>(?<![\w.)])["'])|(?P<m>,|:(?=[\s,\[\]{}]|$)|(?<=["'\]}]):)|(?P<w>\s+)|(?P<t>(?:[^\s,\[\]{}:\#"']|:(?![\s,\[\]{}]|$)|(?<!\s)[\#"'])+)""")


def yaml_tokens(text: str) -> tuple[set, list, list]:
    """One or more YAML documents, by lines; flow collections are a chain of tokens of their own."""
    t = Trace()
    levels: list[tuple[int, str]] = []  # (indent, 'M' or 'S')
    lines = re.split(r"\r\n|\n|\r", text)
    i, block, running = 0, None, False  # running: a plain scalar that deeper lines carry on

    def code(level: tuple[int, str]) -> int:
        return LEVEL + 2 * level[0] + (level[1] == "S")

    def flow(at: int, rest: str) -> tuple[int, str]:
        """Follows a flow collection over lines; its last line and what stands after it."""
        stack, j, cur, prev = [], at, rest, "^F"

        def put(cls: str) -> None:
            nonlocal prev
            if (prev, cls) != ("fS", "fS"):  # words of one scalar
                t.pairs.add((prev, cls))
            prev = cls

        while True:
            for m in _YFLOW.finditer(cur):
                kind = m.lastgroup
                if kind == "o":
                    stack.append(_OPEN[m[0]])
                    t.nest.append(_OPEN[m[0]])
                    put("f" + m[0])
                elif kind == "x":
                    t.nest.append(-_CLOSE[m[0]])
                    if stack:
                        stack.pop()
                    put("f" + m[0])
                    if not stack:
                        put("$F")
                        return j, cur[m.end() :]
                elif kind == "c":
                    break
                elif kind == "b":  # a quote that isn't closed on this line
                    q = m[0]
                    close = re.compile(r'(?:[^"\\]|\\.)*+"' if q == '"' else r"(?:[^']|'')*+'")
                    k = j + 1
                    while k < len(lines) and not close.match(lines[k]):
                        k += 1
                    put("fS")
                    if k == len(lines):
                        t.nest.append(QUOTE)
                        return k, ""
                    j, cur = k - 1, lines[k]
                    lines[k] = cur[close.match(cur).end() :]
                    break
                elif not stack:
                    continue  # an anchor or a tag
                elif kind == "m":
                    put("f" + m[0])
                elif kind != "w":
                    put("fS")
            j += 1
            if j >= len(lines):
                return j, ""
            cur = lines[j]

    def scalar(v: str) -> tuple[str, str]:
        """Kind of a value (none, value, block, flow, quote or plain) and, where it holds a token too many, that token."""
        m = _YSCALAR.match(v)
        if not m:
            bare = v.lstrip()
            if bare[:1] in ("'", '"'):
                whole = _YQUOTED.match(bare)
                return ("value", "TEXT") if whole else ("quote", "")
            return "plain", bare[:1] or "TEXT"
        if m["plain"] is not None:
            p = re.split(r"\s#", m["plain"])[0].rstrip()
            if re.search(r":(\s|$)", p):
                return "plain", ":"
            if p[:2] in ("- ", "? ") or p == "-":
                return "plain", p[0]
            return "plain", ""
        for k in ("q", "flow", "block", "alias"):
            if m[k] is not None:
                return {"q": "value", "alias": "value"}.get(k, k), ""
        return "none", ""

    def pop() -> None:
        t.nest.append(-code(levels.pop()))

    def push(level: tuple[int, str]) -> None:
        levels.append(level)
        t.nest.append(code(level))

    def place(indent: int, sort: str) -> str:
        """Relation of a line to the open levels, which are updated."""
        level = (indent, sort)
        if not levels:
            push(level)
            return ""
        if indent > levels[-1][0]:
            push(level)
            return ">"
        back = False
        while levels and indent < levels[-1][0]:
            pop()
            back = True
        if levels and levels[-1] == level:
            return "<" if back else "="
        if levels and levels[-1][0] == indent:
            if sort == "S" and levels[-1][1] == "M" and not back and t.prev.endswith("KEY"):
                push(level)
                return "="
            if sort == "M" and len(levels) > 1 and levels[-2] == level:
                pop()
                return "<"
        t.nest.append(-code(level))  # no such level is open
        return "<"

    def clear() -> None:
        while levels:
            pop()

    while i < len(lines):
        raw = lines[i]
        i += 1
        if not raw.strip() or raw.lstrip().startswith("#"):
            if block is None or not raw.strip():
                continue
        indent = len(raw) - len(raw.lstrip(" "))
        if block is not None:
            if indent > block:
                continue
            block = None
            if raw.lstrip().startswith("#"):
                continue
        if raw[indent : indent + 1] == "\t" and indent <= (levels[-1][0] if levels else -1):
            t.add("TAB")
            continue
        if running and indent > (levels[-1][0] if levels else -1) and not (m := _YKEY.match(raw[indent:])):
            t.add((">" if levels else "=") + "PLAIN")
            if re.search(r":(?:\s|$)", re.split(r"\s#", raw)[0]):
                t.add(":")
            continue
        running = False
        if raw.startswith(("---", "...")) and (len(raw) == 3 or raw[3] in " \t"):
            t.add("DOC")
            clear()
            rest = raw[3:].strip()
            running = False
            if raw[0] == "-" and rest and not rest.startswith("#"):
                kind, more = scalar(rest)
                if kind == "block":
                    block = -1
                elif kind == "flow":
                    i, after = flow(i - 1, rest)
                    i += 1
                    more = "TEXT" if after.strip() and not re.match(r"\s*#", after) else ""
                if more:
                    t.add(more)
                elif kind != "none":
                    t.add("VALUE")
            continue
        if raw.startswith("%"):
            continue
        body = raw[indent:]
        while True:
            if body[:1] in "-?:" and body[1:2] in ("", " ", "\t") and body:
                sort, own_class = ("S", "DASH") if body[0] == "-" else ("M", "KEY")  # ? and : set a key and its value apart
                rest = body[1:]
                rel = place(indent, sort)
                inner = rest.lstrip(" ")
                if not inner or inner.startswith("#"):
                    t.add(rel + own_class)
                    break
                if inner.startswith("- ") or inner == "-" or _YKEY.match(inner) and not inner.startswith(("[", "{")):
                    t.add(rel + own_class)
                    indent += 1 + len(rest) - len(inner)
                    body = inner
                    continue
                (kind, more), at, own, name = scalar(inner), inner, indent, "ITEM" if sort == "S" else "KV"
            elif m := _YKEY.match(body):
                rel = place(indent, "M")
                (kind, more), at, own, name = scalar(m["v"]), m["v"].strip(), indent, "KV"
                if kind == "none":
                    t.add(rel + "KEY")
                    break
            else:
                (kind, more), at, own, name = scalar(body), body, indent, "PLAIN"
                if kind in ("flow", "value"):
                    name = "VALUE"
                top = levels[-1][0] if levels else -1
                rel = ("" if t.prev in ("^", "DOC") else ">") if indent > top else "=" if indent == top else "<"
                if t.prev.lstrip("<=>") == "PLAIN" and not levels:
                    rel = "="
            t.add(rel + name)
            running = kind == "plain" and not more
            if more:
                t.add(more)
            elif kind == "block":
                block = own
            elif kind == "flow":
                i, after = flow(i - 1, at)
                i += 1
                if after.strip() and not re.match(r"\s+#", after):
                    t.add(":" if after.lstrip().startswith(":") and name == "VALUE" else "TEXT")
            elif kind == "quote":
                q = at.lstrip()[0]
                close = re.compile(r'(?:[^"\\]|\\.)*+"' if q == '"' else r"(?:[^']|'')*+'")
                while i < len(lines) and not close.match(lines[i]):
                    i += 1
                if i == len(lines):
                    t.nest.append(QUOTE)
                elif not re.fullmatch(r"\s*(?:\s#.*)?", lines[i][close.match(lines[i]).end() :]):
                    t.add("TEXT")
                i += 1
            break
    clear()
    return t.end()


_PY = re.compile(
    r"""[ \t\f]*(?:(?P<w>[^\W\d][\w\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u065f\u0900-\u0e4e\u200c\u200d]*+)(?!["'])|(?P<q>[()\[\],])|(?P<nl>\r\n|\n|\r)|(?P<c>\#[^\r\n]*)|(?P<cont>\\(?:\r\n|\n|\r))"""
    r"""|(?P<str>[rRbBuUfFtT]{0,2}(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'))"""
    r"""|(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)|(?P<word>[^\W\d]\w*)"""
    r"""|(?P<p>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[+\-*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<bad>\S))""",
    re.S | re.X,
)
_PYKEY = frozenset("if else for in is not lambda await async yield from import as return raise assert del global nonlocal pass break continue def class with while try except finally elif and or".split())
_PYOP = {"and": "OP", "or": "OP", "nonlocal": "global", "-": "+", "//": "OP", "%": "OP", "<<": "OP", ">>": "OP", "<=": "OP", ">=": "OP", "==": "OP", "!=": "OP", "&": "OP", "^": "OP", "<": "OP", ">": "OP"}
#: Classes of words and signs wherever in a line they stand; the others depend on their place.
_PYWORD = {k: _PYOP.get(k, k) for k in _PYKEY} | dict.fromkeys(["lambda", "for", "else", "if"])
_PYSIGN = {k: _PYOP.get(k, k) for k in "... -> := ** // << >> <= >= == != - + * / % @ & | ^ ~ < > . ; =".split()}
_PYSIGN |= {k: "AUG" for k in "**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split()}
#: Classes after which a statement starts.
_PYSTART = frozenset(["^", "NL", "NL:", "IN"])
_HEADS = frozenset("if elif else for while try except finally def class with".split())


def python_tokens(text: str) -> tuple[set, list, list]:
    """Python 3.13. Statements of one block give pairs of classes beginning with H:, the kind of a line and how it ends pairs
    of classes beginning with L:. Indentation, conditionals up to their else and lambdas up to their colon nest."""
    t, depth, start, head, colon = Trace(), 0, True, "", False
    indents: list[tuple[int, str, int]] = [(0, "H:^", 0)]
    seq = ["^"]  # all classes in order
    append, nest = seq.append, t.nest
    owed: list[list[int]] = [[0, 0]]  # of each open bracket: lambdas without colon, for seen

    def finish() -> None:
        """The end of a statement's line."""
        kind = "H" if head in _HEADS or head in ("match", "case") else "S"
        t.pairs.add(("L:" + kind, "L::" if (colon if kind == "H" else seq[-1] == ":") else "L:$"))
        append("NL:" if seq[-1] == "B:" else "NL")

    space, chars, fresh = 0, 0, True
    for m in _PY.finditer(text.lstrip("\ufeff") if text[:1] == "\ufeff" else text):
        k = m.lastindex
        v = m[k]
        if not (start or fresh):  # within a line
            if k == 1:
                if cls := _PYWORD.get(v, "NAME"):
                    append(cls)
                    continue
            elif k == 2:
                if v == ",":
                    append(",E" if head == "except" and not depth else v)
                elif v in _OPEN:
                    depth += 1
                    owed.append([0, 0])
                    nest.append(_OPEN[v])
                    append(v)
                else:
                    depth = max(0, depth - 1)
                    if len(owed) > 1:
                        owed.pop()
                    nest.append(-_CLOSE[v])
                    append(v)
                continue
            elif cls := _PYSIGN.get(v):
                append(cls)
                continue
            elif k == 6:
                append("STR")
                continue
            elif k == 3 and depth:
                continue
        kind = m.lastgroup
        if fresh:  # the first token of a line
            lead = m.start(kind) - m.start()
            space, chars, fresh = (len(m[0][:lead].expandtabs(8)) if lead else 0), lead, False
        if kind == "c" or kind == "cont":
            continue
        if kind == "word":
            kind = "w"
        if kind == "nl":
            if depth == 0 and not start:
                finish()
                start, owed = True, [[0, 0]]
            fresh = depth == 0
            continue
        if start and depth == 0:
            start, colon = False, False
            head = v if kind == "w" else ""
            if head == "async":
                rest = text[m.end() : m.end() + 12].split()
                head = rest[0] if rest else ""
            soft = head in ("match", "case") and re.match(r"(?:match|case)\b(?!\s*[=.,)\]:(]|\s*$|\s+(?:in|is|and|or|not|if)\b)[^\r\n]*:\s*(?:#.*)?$|(?:match|case)\s*[\[({][^\r\n]*:\s*(?:#.*)?$", text[m.start(m.lastgroup) : m.start(m.lastgroup) + 400].split("\n")[0].rstrip("\r"))
            if head in ("match", "case") and not soft:
                head = ""
            if space > indents[-1][0] and chars > indents[-1][2]:
                indents.append((space, "H:^M" if indents[-1][1] == "H:MATCH" else "H:^", chars))
                t.nest.append(LEVEL + 1024 * space + chars)
                append("IN")
            else:
                while len(indents) > 1 and space < indents[-1][0]:
                    last = indents.pop()
                    t.pairs.add((last[1], "H:$"))
                    t.nest.append(-(LEVEL + 1024 * last[0] + last[2]))
                if space != indents[-1][0] or chars != indents[-1][2]:
                    t.nest.append(-(LEVEL + 1024 * space + chars))  # no such level is open
            label = "H:" + (head if head in _HEADS else {"match": "MATCH", "case": "CASE"}.get(head, "@" if v == "@" else "S"))
            t.pairs.add((indents[-1][1], label))
            indents[-1] = (indents[-1][0], label, indents[-1][2])
        if kind == "w":
            if v in _PYKEY:
                cls = _PYOP.get(v, v)
                own = owed[-1]
                if v == "lambda":
                    own[0] += 1
                    t.nest.append(LAMBDA)
                elif v == "for":
                    own[1] = 1
                elif seq[-1] in _PYSTART:
                    pass
                elif v == "else":
                    t.nest.append(-TERNARY)
                elif v == "if" and not own[1] and not (head == "case" and depth == 0):
                    t.nest.append(TERNARY)
            elif v in ("match", "case") and seq[-1] in _PYSTART and head == v:
                cls = v.upper()
            elif v == "type" and (seq[-1] in _PYSTART or seq[-1] == ";") and re.match(r"type\s+[^\W\d]\w*\s*[=\[]", text[m.start(m.lastgroup) : m.start(m.lastgroup) + 80]):
                cls = "TYPE"
            else:
                cls = "NAME"
        elif kind == "str":
            cls = "STR"
        elif kind == "num":
            cls = "NUM"
            if re.match(r"0\d*[1-9]\d*$", v):  # a zero and another number
                append("NUM")
        elif kind == "p" or kind == "q":
            cls = _PYSIGN.get(v, v)
            if v in _OPEN:
                depth += 1
                owed.append([0, 0])
                t.nest.append(_OPEN[v])
            elif v in _CLOSE:
                depth = max(0, depth - 1)
                if len(owed) > 1:
                    owed.pop()
                t.nest.append(-_CLOSE[v])
            elif v == ":" and owed[-1][0] > 0:
                owed[-1][0] -= 1
                t.nest.append(-LAMBDA)
                cls = "L:"
            elif v == ":" and depth == 0:
                colon = True
                cls = "B:" if head in _HEADS or head in ("match", "case") else ":"
            elif v == "," and depth == 0 and head == "except":
                cls = ",E"
        elif v in "\"'":
            t.nest.append(QUOTE)
            cls = "STR"
        else:
            cls = v
        append(cls)
    if not start:
        finish()
    for space, label, chars in indents[::-1]:
        t.pairs.add((label, "H:$"))
        if label and (space or chars):
            t.nest.append(-(LEVEL + 1024 * space + chars))
    append("$")
    t.pairs.update(zip(seq, seq[1:]))
    return t.pairs, t.nest, t.keys


_SH_RESERVED = frozenset("if then elif else fi for while until do done case esac function { } ! [[ select".split())
_SH_NEST = {
    "if": [COND], "then": [-COND, THEN], "elif": [-THEN, COND], "else": [-THEN, THEN], "fi": [-THEN], "for": [LOOP], "while": [LOOP], "until": [LOOP], "select": [LOOP],
    "do": [-LOOP, DO], "done": [-DO], "case": [CASE_HEAD], "esac": [-CASE_BODY], "{": [CURLY], "}": [-CURLY],
}
_SH = re.compile(r"(?P<ws>(?:[ \t]|\\\n)+)|(?P<nl>\r?\n)|(?P<c>(?<![^\s;&|()])#[^\n]*)|(?P<p>;;&|;;|;&|;|&&|\|\||\|&|&>>|&>|\||&|\(\(|[()])|(?P<r>\d*(?:<<<|<<-|<<|<&|<>|>>|>&|>\||<\(|>\(|<|>)(?:-(?=\s))?)|(?P<w>.)", re.S)


_SH_PATTERN = re.compile(r"""(?:\\.|"(?:[^"\\]|\\.)*"|'[^']*'|[^\n)\\])*""", re.S)


def _sh_word(t: Trace, text: str, i: int) -> int:
    """End of the word at i; quotes and expansions that aren't closed are opening events."""
    n = len(text)
    while i < n:
        c = text[i]
        if c in " \t\n;&|()<>" or c == "\r" and text.startswith("\r\n", i):
            return i
        if c == "\\":
            i += 2
        elif c == "'":
            i = _sh_until(t, text, i + 1, "'", False)
        elif c == '"':
            i = _sh_quoted(t, text, i + 1)
        elif c in "$`":
            i = _sh_expand(t, text, i)
        else:
            i += 1
    return min(i, n)


def _sh_until(t: Trace, text: str, i: int, close: str, escapes: bool) -> int:
    """The place after the next closing sign."""
    n = len(text)
    if not escapes:
        j = text.find(close, i)
    else:
        j = i
        while j < n and text[j] != close:
            j += 2 if text[j] == "\\" else 1
        j = j if j < n else -1
    if j < 0:
        t.nest.append(QUOTE)
        return n
    return j + 1


def _sh_quoted(t: Trace, text: str, i: int) -> int:
    n = len(text)
    while i < n:
        c = text[i]
        if c == '"':
            return i + 1
        if c == "\\":
            i += 2
        elif c in "$`":
            i = _sh_expand(t, text, i)
        else:
            i += 1
    t.nest.append(QUOTE)
    return n


def _sh_arith(t: Trace, text: str, i: int) -> int:
    """The place after )) that closes an arithmetic expression, which begins at i; -1 if no )) does."""
    n, depth = len(text), 2
    while i < n and depth:
        depth += (text[i] == "(") - (text[i] == ")")
        i += 1
    return i if not depth and text[i - 2] == ")" else -1


def _sh_expand(t: Trace, text: str, i: int) -> int:
    """End of the expansion at i ($x, ${...}, $(...), $((...)), `...`). The commands of $(...) are a text of their own."""
    n = len(text)
    if text[i] == "`":
        return _sh_until(t, text, i + 1, "`", True)
    nxt = text[i + 1 : i + 2]
    if nxt == "'":
        return _sh_until(t, text, i + 2, "'", True)
    if nxt == "{":
        j = i + 2
        while j < n and text[j] != "}":
            c = text[j]
            if c == "\\":
                j += 2
            elif c == "'":
                k = text.find("'", j + 1)
                j = k + 1 if k >= 0 else j + 1
            elif c == '"':
                j = _sh_quoted(t, text, j + 1)
            elif c in "$`":
                j = _sh_expand(t, text, j)
            else:
                j += 1
        if j >= n:
            t.nest.append(CURLY)
        return min(j + 1, n)
    if nxt == "(":
        if text.startswith("(", i + 2) and (j := _sh_arith(t, text, i + 3)) >= 0:
            return j
        return _sh_inner(t, text, i + 2)
    return i + 1


def _sh_inner(t: Trace, text: str, i: int) -> int:
    """End of commands in round brackets; they are a chain of tokens of their own."""
    prev, t.prev = t.prev, "^"
    t.nest.append(ROUND)
    i = _shell(t, text, i, True)
    t.add("$")
    t.prev = prev
    return i


def _sh_list(t: Trace, text: str, i: int) -> int:
    """End of an array's items, which begin at i."""
    n = len(text)
    t.nest.append(ROUND)
    while i < n:
        c = text[i]
        if c == ")":
            t.nest.append(-ROUND)
            return i + 1
        if c == "#" and text[i - 1] in " \t\n(":
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif c in " \t\r\n":
            i += 1
        else:
            j = _sh_word(t, text, i)
            if j == i:
                t.pairs.add(("(A", c))
                j += 1
            i = j
    return n


def shell_tokens(text: str) -> tuple[set, list, list]:
    """bash, by command words; quotes and expansions are part of their word."""
    t = Trace()
    _shell(t, text, 0, False)
    return t.end()


def _shell(t: Trace, text: str, i: int, inside: bool) -> int:
    """Tokens from i on, up to the ) that closes them if they are inside round brackets; the place after it."""
    n, open_ = len(text), 0
    command, docs, heads = True, [], []  # at a command's start; here-documents to come; open case and for heads
    cases: list[str] = []
    while i < n:
        m = _SH.match(text, i)
        kind, v = m.lastgroup, m[0]
        if kind in ("ws", "c"):
            i = m.end()
            continue
        if kind == "nl" or v == ";":
            i = m.end()
            if kind == "nl":
                for word, dash in docs:
                    while i < n:
                        j = text.find("\n", i)
                        j = n if j < 0 else j
                        line = text[i:j].rstrip("\r")
                        i = min(j + 1, n)
                        if (line.lstrip("\t") if dash else line) == word:
                            break
                docs = []
            if kind == "p" or t.prev != "NL":
                t.add("NL")
            command = True
            continue
        if kind == "r":
            i = m.end()
            if v.endswith("("):
                i = _sh_inner(t, text, i)
                t.add("WORD")
                command = False
                continue
            while i < n and text[i] in " \t":
                i += 1
            end = _sh_word(t, text, i)
            if end > i and v.lstrip("0123456789") in ("<<", "<<-"):
                docs.append((re.sub(r"[\\'\"]", "", text[i:end]), v.endswith("-")))
                t.add("HEREDOC")
            else:
                t.add(">")
                if end > i:
                    t.add("WORD")
            i = end
            continue
        if kind == "p":
            i = m.end()
            if v == "((" and command and (end := _sh_arith(t, text, i)) >= 0:
                t.add("ARITH")
                i, command = end, False
                continue
            if v == "((":
                v, i = "(", i - 1
            if v == "(":
                close = re.compile(r"[ \t]*\)").match(text, i)
                if close and t.prev in ("WORD", "function"):
                    t.add("FUNC")
                    i, command = close.end(), True
                    continue
                if t.prev == "WORD" and text[i - 2] == "=" or t.prev == "ASSIGN":
                    i = _sh_list(t, text, i)
                    t.add("WORD")
                    continue
                if cases and t.prev in ("in", "NL", ";;") and cases[-1] == "body":
                    continue
                open_ += 1
                t.nest.append(ROUND)
                t.add("(")
                command = True
                continue
            if v == ")":
                if cases and cases[-1] == "pattern":
                    cases[-1] = "run"
                    t.add("PATTERN")
                    command = True
                    continue
                t.nest.append(-ROUND)
                if inside and not open_:
                    return i
                open_ -= 1
                t.add(")")
                command = False
                continue
            if v in (";;", ";&", ";;&"):
                if cases:
                    cases[-1] = "body"
                t.add(";;")
                command = True
                continue
            if v in ("&>", "&>>"):
                while i < n and text[i] in " \t":
                    i += 1
                end = _sh_word(t, text, i)
                t.add(">")
                if end > i:
                    t.add("WORD")
                i = end
                continue
            t.add({"|&": "|"}.get(v, v))
            command = True
            continue
        end = _sh_word(t, text, i)
        word = text[i:end]
        i = max(end, i + 1)
        if cases and cases[-1] == "body" and word != "esac":
            cases[-1] = "pattern"
        if cases and cases[-1] == "pattern":
            rest = _SH_PATTERN.match(text, i)
            i = rest.end()
            if i >= n or text[i] != ")":
                t.nest.append(PATTERN)
            continue
        if heads and word in ("in", "do") and t.prev in ("WORD", "NL"):
            what = heads.pop()
            if word == "in":
                t.add("in")
                if what == "case":
                    t.nest += [-CASE_HEAD, CASE_BODY]
                    cases.append("body")
                command = False
                continue
        # A word that closes a compound command is one after another such command as well.
        if word in _SH_RESERVED and (command or t.prev in (")", "fi", "done", "esac", "}") and word in _SH_NEST):
            t.nest += _SH_NEST.get(word, [])
            if word == "[[":
                stop = re.compile(r"(?:[^\"'\]\n]|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\](?!\]))*\]\]").match(text, i)
                t.add("TEST")
                if not stop:
                    t.nest.append(TEST)
                i = stop.end() if stop else n
                command = False
                continue
            t.add("for" if word == "select" else word)
            if word in ("case", "for", "select"):
                heads.append("for" if word == "select" else word)
            if word == "esac" and cases:
                cases.pop()
            command = word not in ("case", "for", "select", "function", "fi", "done", "esac", "}")
            continue
        if command and re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", word):
            t.add("ASSIGN")
            continue
        t.add("WORD")
        command = False
    return n


_JS = re.compile(
    r"""[ \t\f\v\xa0\ufeff]*(?:(?P<w>\#?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)"""
    r"""|(?P<nl>[\r\n\u2028\u2029]+)|(?P<c>//[^\r\n]*|/\*.*?\*/)|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')"""
    r"""|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.`])|(?P<bad>\S))""",
    re.S | re.X,
)
_JSKEY = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch throw try typeof var void while let async await yield static of".split())
_JSRESERVED = _JSKEY - {"let", "async", "await", "yield", "static", "of"} | frozenset(["enum", "with"])
#: Words whose class depends on what follows.
_JSPLACE = frozenset("from as of get set let async await yield static".split())
_JSOP = {"delete": "UN", "typeof": "UN", "void": "UN", "!": "UN", "~": "UN", "-": "+", "--": "++", "instanceof": "BIN", "debugger": "debugger"}
_JSBIN = frozenset("=== !== >>> == != <= >= && || ?? << >> ** < > % & | ^".split())
_JSSET = frozenset(">>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^=".split())
_JSREGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*")
_VALUE_END = frozenset(["ID", "NUM", "STR", "TEMPLATE", "REGEX", ")", "]", "}", "}O", "}C", "`}", "++"])


def js_tokens(text: str) -> tuple[set, list, list]:
    """JavaScript, as script or module. Lines that end a statement count as ; where the grammar needs one."""
    t, i, n = Trace(), 0, len(text)
    stack: list[list] = [["B", "", 0]]  # kind of block, word that opened it, open conditionals
    newline, closed = False, ""  # closed: what the last closed round bracket belonged to
    match = _JS.match
    seq = ["^", "^"]  # all classes in order
    put = seq.append
    joints: list[int] = []  # after which of them a line ends

    def add(cls: str) -> None:
        nonlocal newline
        if newline:
            if len(seq) > 2:
                t.pairs.add((seq[-1] + "~", cls))
                joints.append(len(seq) - 1)
            newline = False
        put(cls)

    if text.startswith("#!"):
        i = (text.find("\n") + n + 1) % (n + 1)
    while i < n:
        m = match(text, i)
        if m is None:
            break
        kind = m.lastgroup
        v = m[kind]
        if kind == "nl" or kind == "c":
            newline |= kind == "nl" or "\n" in v
            i = m.end()
            continue
        top = stack[-1]
        prev = seq[-1]
        if kind == "p" and v[0] == "/" and prev not in _VALUE_END and (r := _JSREGEX.match(text, m.start(kind))):
            add("REGEX")
            i = r.end()
            continue
        i = m.end()
        if kind == "w":
            member = prev == "." or prev == "?."
            if member or v[0] == "#":
                add("ID")
                continue
            if top[0] not in "OC" and v not in _JSPLACE:
                if v not in _JSRESERVED:
                    add("ID")
                    continue
                after = ""
            else:
                after = text[i : i + 40].lstrip()
            key = top[0] in ("O", "C") and prev in ("{O", "{C", ",", ";", "}", "get", "set", "async", "static", "*", "]", "STR", "ID", "NUM") and after[:1] in ("(", ":", "=", ";", ",", "}")
            if top[0] == "C" and prev not in ("=", "ID", ".", "extends") and v in ("get", "set", "static", "async") and after[:1] not in ("(", "=", ";"):
                if newline and prev not in ("{C", ";", "}"):
                    add(";")
                add(v)
            elif top[0] == "O" and prev in ("{O", ",") and v in ("get", "set", "async") and after[:1] not in ("(", ":", ",", "}"):
                add(v)
            elif key and (prev in ("{O", "{C", "get", "set", "async", "static", "*") or top[0] == "C" or prev == "," and top[0] == "O"):
                add("ID")
            elif prev == "as" and not newline or v == "default" and top[0] == "O" and prev in ("{O", ","):
                add("ID")  # names that a module gives
            elif v in ("from", "as", "of", "get", "set"):
                soft = v == "from" and prev in ("ID", "}O", "*") or v == "as" and prev in ("ID", "*", "default") or v == "of" and top[0] == "(" and prev in ("ID", "]", "}O", "}")
                add(v if soft and not newline else "ID")
            elif v == "let" and not (after[:1] in "[{" or re.match(r"[A-Za-z_$]", after)):
                add("ID")
            elif v in ("async", "await", "yield", "static"):
                if v == "async" and (after.startswith("function") or re.match(r"(?:\(|[A-Za-z_$])", after)):
                    add("async")
                elif v == "await" and re.match(r"[\w$(\[{'\"`!+~/-]", after):
                    add("await")
                elif v == "yield":
                    add("yield")
                else:
                    add("static" if v == "static" and top[0] == "C" else "ID")
            elif v in _JSRESERVED:
                cls = _JSOP.get(v, v)
                if v == "return" and not any(s[0] == "B" and s[1] == "function" for s in stack):
                    cls = "return^"
                if v in ("case",) and top[0] != "S" or v == "default" and top[0] not in ("S",) and prev not in ("export", ".", "{O", ","):
                    cls += "^"
                add(cls)
                if v in ("case", "default") and top[0] == "S":
                    top[1] = "case"
            elif v in ("let", "of"):
                add(v)
            else:
                add("ID")
        elif kind == "num":
            add("NUM")
        elif kind == "str":
            add("STR")
        elif kind == "bad":
            if v in "\"'":
                t.nest.append(QUOTE)
            add("STR" if v in "\"'" else v)
        elif v == "`" or v == "}" and top[0] == "T":
            if v == "}":
                t.nest.append(-INTERP)
                stack.pop()
            j = i
            while j < n and text[j] != "`" and not text.startswith("${", j):
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                add("TEMPLATE" if v == "`" else "`}")
                t.nest.append(QUOTE)
                i = n
            elif text[j] == "`":
                add("TEMPLATE" if v == "`" else "`}")
                i = j + 1
            else:
                add("`" if v == "`" else "}`")
                t.nest.append(INTERP)
                stack.append(["T", "", 0])
                i = j + 2
        elif v == "{":
            t.nest.append(CURLY)
            word = top[3] if len(top) > 3 else ""
            if prev == ")" and seq[-1] == ")":
                opener = "function" if closed == "call" else closed
            else:
                opener = ""
            if opener == "switch":
                stack.append(["S", "", 0])
                add("{S")
            elif opener == "catch":
                stack.append(["B", "", 0])
                stack[-1][1] = "catch"
                add("{K")
            elif prev == "try" or prev == "do":
                stack.append(["B", prev, 0])
                add("{T" if prev == "try" else "{D")
            elif prev == "catch":
                stack.append(["B", "catch", 0])
                add("{K")
            elif word == "class":
                top.pop()
                stack.append(["C", "", 0])
                add("{C")
            elif prev == ")" or prev == "=>":
                fn = prev == "=>" or opener in ("function", "", "method")
                stack.append(["B", "function" if fn else "", 0])
                add("{")
            elif prev in ("else", "finally", "static", "^", ";", "{", "}", "{T", "{K", "{D", ":C", ":L", "}T", "}K", "}D", "}C") or newline and prev in _VALUE_END and top[0] in ("B", "S"):
                stack.append(["B", "", 0])
                add("{")
            else:
                stack.append(["O", "", 0])
                add("{O")
        elif v == "}":
            t.nest.append(-CURLY)
            done = stack.pop() if len(stack) > 1 else ["B", "", 0]
            tag = {"O": "}O", "C": "}C", "S": "}S"}.get(done[0], "}" + {"try": "T", "catch": "K", "do": "D"}.get(done[1], ""))
            add(tag)
        elif v in "([":
            t.nest.append(_OPEN[v])
            what = ""
            if v == "(":
                if prev in ("if", "for", "while", "switch", "catch") or prev == "await" and seq[-2] == "for":
                    what = "for" if prev == "await" else prev
                elif prev == "function" or seq[-2] == "function" and prev in ("ID", "*") or seq[-2] == "*" and prev == "ID":
                    what = "function"
                elif top[0] in ("O", "C") and prev in ("ID", "STR", "NUM", "]"):
                    what = "method"
                else:
                    what = "call"
            stack.append([v, what, 0])
            add(v)
        elif v in ")]":
            t.nest.append(-_CLOSE[v])
            done = stack.pop() if len(stack) > 1 else ["B", "", 0]
            closed = done[1]
            add(v)
        elif v == ":":
            if top[2]:
                top[2] -= 1
                add(":T")
            elif top[0] == "S" and top[1] == "case":
                top[1] = ""
                add(":C")
            elif top[0] == "O":
                add(":O")
            elif top[0] in ("B", "S") and prev == "ID" and seq[-2] in ("^", ";", "{", "}", "{T", "{K", "{D"):
                add(":L")
            else:
                add(":")
        elif v == "?":
            top[2] += 1
            add("?")
        elif v in _JSSET:
            add("ASSIGN")
        elif v in _JSBIN:
            add("BIN")
        elif v == ";" and top[0] == "(" and top[1] != "for":
            add(";(")
        else:
            add(_JSOP.get(v, v))
        if kind == "w" and v == "class" and seq[-1] == "class":
            top.append("class") if len(top) == 3 else None
    put("$")
    at = 1
    for j in [*joints, len(seq) - 1]:
        t.pairs.update(zip(seq[at:j], seq[at + 1 : j + 1]))
        at = j + 1
    return t.pairs, t.nest, t.keys


LEXERS = {"py": python_tokens, "js": js_tokens, "sh": shell_tokens, "json": json_tokens, "yaml": yaml_tokens, "toml": toml_tokens}
