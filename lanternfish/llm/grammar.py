"""Pairs of adjacent tokens that a grammar permits.

A grammar is a text of rules ``name: alternative | alternative``; elements are names of rules, terminals in quotes or
capitals, groups in brackets, with ``?``, ``*`` and ``+`` after them. ``^`` stands for the start of a text, ``$`` for
its end.
"""

from __future__ import annotations

import re

_PART = re.compile(r"\s*('[^']*'|[A-Za-z_][\w^!]*|[()|?*+])")


class _Set:
    """What an element can begin and end with, whether it can be empty, and the pairs inside it."""

    def __init__(self) -> None:
        self.first: set[str] = set()
        self.last: set[str] = set()
        self.empty = False
        self.pairs: set[tuple[str, str]] = set()

    def size(self) -> int:
        return len(self.first) + len(self.last) + self.empty + len(self.pairs)


def _parse(text: str) -> list:
    """A rule's right side as nested lists: ["|", [...]], ["seq", [...]], ["rep", x, mark], or a name."""
    parts = _PART.findall(text)
    at = 0

    def alternatives() -> list:
        nonlocal at
        found = [sequence()]
        while at < len(parts) and parts[at] == "|":
            at += 1
            found.append(sequence())
        return ["|", found]

    def sequence() -> list:
        nonlocal at
        items: list = []
        while at < len(parts) and parts[at] not in ("|", ")"):
            if parts[at] == "(":
                at += 1
                x: object = alternatives()
                at += 1
            else:
                x = parts[at]
                at += 1
            while at < len(parts) and parts[at] in ("?", "*", "+"):
                x = ["rep", x, parts[at]]
                at += 1
            items.append(x)
        return ["seq", items]

    return alternatives()


def permitted(grammar: str, start: str) -> set[tuple[str, str]]:
    """Every (terminal, next terminal) of some text of the grammar."""
    rules = {}
    for block in re.split(r"\n(?=\w+:)", grammar.strip()):
        name, _, body = block.partition(":")
        rules[name.strip()] = _parse(body)
    sets = {n: _Set() for n in rules}

    def of(x: object) -> _Set:
        if isinstance(x, str):
            if x in sets:
                return sets[x]
            s = _Set()
            t = x.strip("'")
            s.first, s.last = {t}, {t}
            return s
        out = _Set()
        if x[0] == "|":
            for y in map(of, x[1]):
                out.first |= y.first
                out.last |= y.last
                out.empty |= y.empty
                out.pairs |= y.pairs
            return out
        if x[0] == "rep":
            y = of(x[1])
            out.first, out.last, out.pairs = set(y.first), set(y.last), set(y.pairs)
            out.empty = y.empty or x[2] in "?*"
            if x[2] in "*+":
                out.pairs |= {(a, b) for a in y.last for b in y.first}
            return out
        out.empty = True
        for y in map(of, x[1]):
            out.pairs |= y.pairs | {(a, b) for a in out.last for b in y.first}
            out.first |= y.first if out.empty else set()
            out.last = y.last | out.last if y.empty else set(y.last)
            out.empty &= y.empty
        return out

    while True:
        before = sum(s.size() for s in sets.values())
        for n, body in rules.items():
            s = of(body)
            sets[n].first |= s.first
            sets[n].last |= s.last
            sets[n].empty |= s.empty
            sets[n].pairs |= s.pairs
        if sum(s.size() for s in sets.values()) == before:
            break
    top = sets[start]
    return top.pairs | {("^", b) for b in top.first} | {(a, "$") for a in top.last} | ({("^", "$")} if top.empty else set())


JSON = """
json: value
value: object | array | STR | NUM | LIT
object: '{' (member (',O' member)*)? '}'
member: KEY ':' value
array: '[' (value (',A' value)*)? ']'
"""

TOML = """
doc: line? (NL line?)*
line: '[H' key ']H' | pair
key: K ('.K' K)*
pair: key '=' value
value: STR | STR3 | NUM | LIT | list | table
list: '[' NL* (value NL* (',A' NL* value NL*)* (',A' NL*)?)? ']'
table: '{' (pair (',O' pair)*)? '}'
"""

#: Lines of YAML: each is named after its place (> deeper, = level, < back at an outer level) and its kind.
YAML_PAIRS = {
    "^": ["$", "DOC", "KEY", "KV", "DASH", "ITEM", "VALUE", "PLAIN"],
    "DOC": ["$", "DOC", "KEY", "KV", "DASH", "ITEM", "VALUE", "PLAIN"],
    "KEY": ["$", "DOC", ">KEY", ">KV", ">DASH", ">ITEM", ">PLAIN", ">VALUE", "=KEY", "=KV", "=DASH", "=ITEM", "<KEY", "<KV", "<DASH", "<ITEM"],
    "KV": ["$", "DOC", ">PLAIN", "=KEY", "=KV", "<KEY", "<KV", "<DASH", "<ITEM"],
    "DASH": ["$", "DOC", ">KEY", ">KV", ">DASH", ">ITEM", ">PLAIN", ">VALUE", "=DASH", "=ITEM", "<KEY", "<KV", "<DASH", "<ITEM"],
    "ITEM": ["$", "DOC", ">PLAIN", "=DASH", "=ITEM", "<KEY", "<KV", "<DASH", "<ITEM"],
    "PLAIN": ["$", "DOC", "=PLAIN", ">PLAIN", "<KEY", "<KV", "<DASH", "<ITEM"],
    "VALUE": ["$", "DOC", "<KEY", "<KV", "<DASH", "<ITEM"],
}


#: A flow collection of YAML.
YAML_FLOW = """
flow: list | map
list: 'f[' (entry ('f,' entry)* 'f,'?)? 'f]'
map: 'f{' (entry ('f,' entry)* 'f,'?)? 'f}'
entry: node ('f:' node?)? | 'f:' node?
node: fS | fS? list | fS? map
"""


def yaml_pairs() -> set[tuple[str, str]]:
    """Pairs of adjacent lines, where the earlier line's place doesn't matter, and of tokens in flow collections."""
    out = {(a + "F" if a == "^" else a, b + "F" if b == "$" else b) for a, b in permitted(YAML_FLOW, "flow")}
    for a, follows in YAML_PAIRS.items():
        for form in (a, f">{a}", f"={a}", f"<{a}"):
            out |= {(form, b) for b in follows}
    # A scalar that deeper lines carry on leaves the level as it was.
    return out | {(">PLAIN", b) for b in ("=KEY", "=KV", "=DASH", "=ITEM")}


PYTHON = """
file: NL? (statement)*
statement: simple (';' simple)* ';'? NL | compound
compound: decorator* (asy? (define | classdef | for | with)) | if | while | try | match
asy: 'async'
decorator: '@' expr NL
define: 'def' NAME typeparams? '(' params? ')' ('->' expr)? 'B:' block
classdef: 'class' NAME typeparams? ('(' args? ')')? 'B:' block
typeparams: '[' NAME (':' expr)? (',' NAME)* ']'
for: 'for' exprs 'in' exprs 'B:' block else?
with: 'with' (expr ('as' expr)?) (',' expr ('as' expr)?)* 'B:' block
if: 'if' named 'B:' block ('elif' named 'B:' block)* else?
else: 'else' 'B:' block
while: 'while' named 'B:' block else?
try: 'try' 'B:' block ('except' '*'? (expr ('as' NAME)?)? 'B:' block)* else? ('finally' 'B:' block)?
match: MATCH exprs 'B:' 'NL:' IN case+
case: CASE pattern ('if' named)? 'B:' block
pattern: exprs | expr 'as' NAME | expr '|' expr
block: simple (';' simple)* NL | 'NL:' IN statement
simple: exprs | assign | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'pass' | 'break' | 'continue' | 'del' exprs | 'assert' expr (',' expr)? | 'global' NAME (',' NAME)* | import | TYPE NAME typeparams? '=' expr
assign: exprs ('=' exprs)+ | expr ':' expr ('=' exprs)? | exprs AUG exprs
import: 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '('? NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ','? ')'?)
dotted: NAME ('.' NAME)*
params: param (',' param)* ','?
param: NAME (':' expr)? ('=' expr)? | '*' (NAME (':' expr)?)? | '**' NAME (':' expr)? | '/'
args: arg (',' arg)* ','?
arg: named generator? | NAME '=' expr | '*' expr | '**' expr
exprs: item (',' item)* ','? | yield
item: named | '*' expr
yield: 'yield' ('from' expr | exprs)?
named: expr | NAME ':=' expr
expr: or ('if' or 'else' expr)? | lambda
lambda: 'lambda' lparams? 'L:' expr
lparams: lparam (',' lparam)* ','?
lparam: NAME ('=' expr)? | '*' NAME? | '**' NAME | '/'
or: unary (binary unary)*
binary: OP | '+' | '*' | '**' | '/' | '|' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '@'
unary: ('not' | '+' | '~' | 'await')* primary
primary: atom ('.' NAME | '(' args? ')' | '[' slices ']')*
slices: slice (',' slice)* ','?
slice: named? (':' expr? (':' expr?)?)? | '*' expr
atom: NAME | NUM | STR+ | '...' | '(' (exprs generator? | named generator)? ')' | '[' (exprs | named generator)? ']' | '{' (exprs | named generator | pairs)? '}'
pairs: pair (',' pair)* ','? | expr ':' expr generator
pair: expr ':' expr | '**' expr
generator: ('async'? 'for' exprs 'in' or ('if' named)*)+
"""

#: A line of Python by its first word (H opens a block, S is any other statement) and its end.
PYTHON_LINE = """
line: 'L:H' 'L::' | 'L:S' 'L:$'
"""

#: Statements of one block of Python, by their first word; s is any simple statement.
PYTHON_BLOCK = """
block: (s | if | loop | try | decorated | other | MATCH)+
decorated: '@'+ ('def' | 'class')
if: 'if' 'elif'* 'else'?
loop: ('for' | 'while') 'else'?
try: 'try' ('except'+ 'else'? 'finally'? | 'finally')
other: 'def' | 'class' | 'with'
s: S
"""

SHELL = """
script: NL? (list (NL | '&' NL?)?)?
list: andor ((NL | '&' NL?) andor)*
andor: pipeline (('&&' | '||') NL? pipeline)*
pipeline: '!'? command ('|' NL? command)*
command: simple | compound redirect*
simple: (WORD | redirect)+ | ASSIGN+ (WORD | redirect)*
redirect: '>' WORD | HEREDOC
body: NL? list (NL | '&' NL?)?
compound: 'if' body 'then' body ('elif' body 'then' body)* ('else' body)? 'fi' | ('while' | 'until') body 'do' body 'done' | 'for' WORD NL? ('in' WORD* NL)? 'do' body 'done' | 'for' ARITH NL? 'do' body 'done' | case | '{' body '}' | '(' body ')' | function | TEST | ARITH
function: FUNC NL? compound | 'function' WORD FUNC? NL? compound
case: 'case' WORD NL? 'in' NL? (PATTERN body? (';;' NL?)?)* 'esac'
"""

JS = """
script: statement*
statement: block | declaration ';' | expr ';' | ';' | 'if' head statement ('else' statement)? | 'for' 'await'? head statement | 'while' head statement | 'do' statement 'while' head ';'? | 'do' '{D' statement* '}D' 'while' head ';'? | 'try' '{T' statement* '}T' (catch finally? | finally) | 'switch' head '{S' case* '}S' | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ID? ';' | 'debugger' ';' | ID ':L' statement | function | classdef | import ';' | export
block: '{' statement* '}'
catch: 'catch' head? '{K' statement* '}K'
finally: 'finally' block
head: '(' ((declaration | expr)? (';' expr?)* | ('const' | 'let' | 'var') target ('of' | 'in') expr | expr ('of' | 'in') expr) ')'
case: ('case' expr ':C' | 'default' ':C') statement*
declaration: ('const' | 'let' | 'var') binding (',' binding)*
binding: target ('=' assign)?
target: ID | array | object
function: 'async'? 'function' '*'? ID? params block
params: '(' (param (',' param)* ','?)? ')'
param: '...'? target ('=' assign)?
classdef: 'class' ID? ('extends' left)? '{C' (member | ';')* '}C'
member: 'static'? ('async' | 'get' | 'set')? '*'? name (params block | ('=' assign)? ';') | 'static' block
name: ID | STR | NUM | '[' assign ']'
import: 'import' (STR | (ID (',' names)? | names) 'from' STR) 
names: '*' 'as' ID | '{O' (ID ('as' ID)? (',' ID ('as' ID)?)* ','?)? '}O'
export: 'export' (declaration ';' | function | classdef | 'default' (expr ';' | function | classdef) | names ('from' STR)? ';' | '*' ('as' ID)? 'from' STR ';')
expr: assign (',' assign)*
assign: conditional | left ASSIGN assign | left '=' assign | arrow | 'yield' '*'? assign?
arrow: 'async'? (params | ID) '=>' (block | assign)
conditional: binary ('?' assign ':T' assign)?
binary: unary (BIN unary | '+' unary | '*' unary | '/' unary | 'in' unary)*
unary: (UN | '+' | 'await')* left '++'? | '++' left
left: 'new'* primary suffix*
suffix: ('.' | '?.') ID | '?.'? '[' expr ']' | '?.'? '(' (arg (',' arg)* ','?)? ')' | TEMPLATE | template
arg: '...'? assign
primary: ID | NUM | STR | REGEX | TEMPLATE | template | array | object | function | classdef | '(' expr ')' | 'super' | 'import' | 'new' '.' ID
template: '`' expr ('}`' expr)* '`}'
array: '[' (','* ('...'? assign) (','+ '...'? assign)* ','*)? ']'
object: '{O' (property (',' property)* ','?)? '}O'
property: name ':O' assign | ID ('=' assign)? | '...' assign | ('async' | 'get' | 'set')? '*'? name params block
"""
