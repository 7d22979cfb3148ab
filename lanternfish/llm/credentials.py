"""Credentials embedded in source code: where they are, and texts in which they are blanked.

Every quoted string without blanks and every long token of a text becomes a row with its context, alphabet and Shannon
entropy, and so do shorter values where the line says what they are. Thresholds, adjusted for alphabet and length,
decide after digests, identifiers, references, words and placeholders are excluded. The context sets how high the threshold
is: a name on the value's own line, on the line before it or before the list that holds it lowers it, as a public format
does; a literal without any of them has to be all but random. Positions are 0-based code points of the whole text.

Null and empty texts give no rows and are returned unchanged; a credential that stands in a text twice gives two
rows; equal files give equal rows under their own ids.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public formats of access keys and tokens.
FORMATS = [
    r"A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[opsur]_[0-9A-Za-z]{16,}",
    r"github_pat_[0-9A-Za-z_]{20,}",
    r"glpat-[0-9A-Za-z_-]{16,}",
    r"npm_[0-9A-Za-z]{16,}",
    r"(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}",
    r"xox[abeoprs]-[0-9A-Za-z-]{16,}",
    r"AIza[0-9A-Za-z_-]{30,}",
    r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
]
#: What a text that holds one of FORMATS holds.
FORMAT_SIGNS = "AKIA ASIA ghp_ gho_ ghs_ ghu_ ghr_ github_pat_ glpat- npm_ _live_ _test_ xox AIza SG. eyJ".split()
FORMAT = re.compile(r"(?<![0-9A-Za-z_])(?:" + "|".join(FORMATS) + ")")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
#: Lower-case text that a line holds if a name on it says that it holds a credential, or one of the formats or schemes
#: stands on it; other lines have nothing but their quoted strings and long tokens.
HINTS = (
    "pass pwd pw secret token key auth bearer basic login cred contrase kennwort clave cle_ mot_de akia asia "
    "ghp_ gho_ ghs_ ghu_ ghr_ github_pat glpat- npm_ _live_ _test_ xox aiza sg. eyj :// sshpass cle- _cle -cle cleapi apicle"
).split()
SKIP = {"token": re.compile(r"token_?bucket|token_?iz"), "pass": re.compile(r"pass(?:ed|es|ing)?(?![\w.-])(?![\"'\s]*[:=])")}
NEEDS = {
    "key": re.compile(r"(?:api|access|secret|sign|signing|encryption|auth|private|account|client|service|master|session|app|shared|hmac|webhook|jwt|deploy|admin|cle|licen[cs]e)[_. -]?$|[?&]$"),
    "pw": re.compile(r"(?:^|[^a-z])$|[a-z][_ -]?$"),
    "sg.": re.compile(r"(?:^|[^a-z])$"),
    "eyj": re.compile(r"(?:^|[^a-z])$"),
}
STRONG = frozenset("password passwd pass pwd pw passphrase passcode passwort kennwort contrasena contraseña clave secret token apikey authtoken pgpassword bearer".split())
#: Names of several credentials; they count before a list only, as tokens and the like are numbers elsewhere.
SEVERAL = frozenset("passwords passphrases passcodes secrets tokens credentials creds apikeys".split())
KEYED = frozenset("api access secret signing sign encryption auth private account client service master session app shared hmac webhook jwt deploy admin cle licence license".split())
#: A name that ends like this is about a credential and doesn't hold one.
ABOUT = frozenset("name names url uri field fields type types len length path file files prefix count expiry expires ttl policy pattern regex hint prompt header env var ref format id ids label bucket buckets scope scopes limit total rotation age min max provider store reset rules description title hash digest fingerprint checksum sha md5 etag signature commit re".split())
WORDS = re.compile(r"[A-Z]+(?![a-zñ])|[A-Z]?[a-zñ]+")
NAMED = re.compile(
    r"""\b(?P<name>[\wñ][\wñ.\-]*(?:\[\s*["'][\w.\- ]+["']\s*\])?)(?P<close>\\?["'])?\]?\s*(?::\s*[A-Za-z_][\w\[\], ]*)?(?:={1,3}|=>|:=|:)\s*(?P<open>[bBrRuUfF]{0,2}(?:\\?["'`]))?""",
)
QUOTED = re.compile(r"""(?P<q>\\?["'`])(?P<v>(?:\\.|(?!(?P=q)).)*?)(?P=q)""")
URL_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@'\"`{}$<>]*:(?P<v>[^\s/@'\"`{}$<>]+)@")
QUERY = re.compile(r"[?&;](?P<name>[\w\-]+)=(?P<v>[^\s&;'\"`{}<>]+)")
SCHEME = re.compile(r"\b(?P<s>Basic|Bearer|Token)\s+(?P<v>[A-Za-z0-9+/_.=~-]{8,})", re.I)
FLAG = re.compile(r"""(?<![\w-])--?(?P<name>[a-z][a-z-]*)(?:\s+|=|["'],\s*)(?P<q>["']?)(?P<v>[^\s"']+(?:(?<=[\w])\s[^\s"'-][^"']*(?=["']))?)""")
PAIR = re.compile(r"""-u\s+(?P<q>["']?)[^\s:"'$]+:(?P<v>[^\s"']+)(?P=q)""")
PROSE = re.compile(r"[PpSs](?<![\w.\"'=-].)(?:(?<=[Pp])ass(?:word|wd|phrase)|(?<=[Ss])ecret)(?:\s+is|:)?\s+(?P<v>[^\s\"'`,;()<>]{6,})")
FALLBACK = re.compile(
    r"""(?:process\.env\.(?P<a>\w+)\s*(?:\|\||\?\?)\s*|(?:environ\.get|getenv)\(\s*["'](?P<b>\w+)["']\s*,\s*|\$\{(?P<c>\w+):?[-=])(?P<q>["'`]?)(?P<v>[^"'`\n${}]+)(?P=q)"""
)
TUPLE = re.compile(r"""["'][\w.+-]+@[\w-]+\.[\w.-]+["']\s*,\s*(?P<q>["'])(?P<v>(?!--)[^"'\n]+)(?P=q)""")
SPREAD = re.compile(r"""\b(?P<name>\w+)\s*=\s*\(\s*\r?\n(?P<body>(?:\s*[bru]{0,2}(?:"[^"\n]*"|'[^'\n]*')\s*\r?\n)+)\s*\)""")
ITEM = re.compile(r"""name["']?\s*[:=]\s*["']?(?P<n>[\w\-]+)["']?\s*(?:#[^\n]*)?[,\n]\s*(?:-\s*)?["']?value["']?\s*[:=]\s*(?=(?P<rest>[^\n]*))""")
SSHPASS = re.compile(r"""\bsshpass["']?[\s,]+["']?-p["']?[\s,]*(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)""")
BLOCK_SCALAR = re.compile(r"[|>](?:[+-]?\d?|\d[+-])\s*(?:#.*)?")
#: What counts while a bracketed list is read: strings, brackets and comments.
IN_LIST = re.compile(r"""(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<o>[\[{(])|(?P<c>[\]})])|(?:#|//)[^\n]*""")
LIST_NAME = re.compile(r"""["']?(?P<name>[\w\-]+)["']?\s*(?::|=>?)\s*$""")
LIST_ITEM = re.compile(r"""(?P<dash>\s*-\s+)(?:(?P<q>["'])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)|(?P<b>[^\s#"'\[{&*!|>][^\s#]*))\s*(?:#.*)?""")

#: Long tokens, and quoted strings without blanks, wherever they stand.
LONG = re.compile(r"(?<![\w+/.~:@%\\?&#-])[A-Za-z0-9+/_-]{20,}={0,2}(?![\w+/~:@%-])")
STRING = re.compile(r"""(?P<q>["'`])(?P<v>[^\s"'`\\]{16,})(?P=q)""")
_AROUND = " \t\r\"',+\\"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:(?:(?!-----BEGIN).)*?-----END \1-----|(?:\s*[A-Za-z0-9+/=]{16,})*)", re.S)
CHANGES = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]")
SIGNS = re.compile(r"[^A-Za-z0-9]")
#: Signs that stand in addresses, paths, patterns, formats and code rather than in a password.
STRUCTURE = re.compile(r"[/\\{}<>()\[\]*|^%$\"'`]|::|\.\.|--|[a-z]:[a-z]|,")
#: A key's own name and a random part: words with _ between them, then the part.
PREFIXED = re.compile(r"(?P<words>[A-Za-z]{2,10}(?:_[A-Za-z]{2,10})*)_(?P<part>[0-9A-Za-z]{20,})|(?P<word>[A-Za-z]{2,10})-(?P<parts>[0-9A-Za-z]{6,}(?:-[0-9A-Za-z]{16,})+)")
#: Shortly before an unnamed long token on its line: what says that it is no credential.
DATA_BEFORE = re.compile(r"data:|base64,|sha\d+[-:=_]|md5[-:=]|ssh-(?:ed25519|rsa|dss)|ecdsa-sha2|integrity", re.I)
NEAR = 40
#: Words of names of long values that are other data.
DATA = frozenset("blob fixture icon image img picture logo font data payload body sample cert certificate crt pem public pub integrity nonce uuid guid sri thumbprint snapshot expected golden encoded content".split())

CALL = re.compile(r"[\w.]*(?:b64decode|atob|decode|getenv|environ\.get|env\.get|Buffer\.from|bytes|str|String)\(\s*|process\.env\.\w+\s*(?:\|\||\?\?)\s*")
MORE = re.compile(r"\s*(?:\+|\.\.|\\\r?\n)?\s*(?=[bruf]{0,2}[\"'`])")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

HEX = re.compile(r"[0-9a-fA-F]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_=.-]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
PHRASE = re.compile(r"[A-Za-z_\- .]+")
DIGEST = re.compile(r"(?:sha\d+|md5)[-:]")
DIGEST_NAME = re.compile(r"(?:sha\d*|md5)[-_:]")
KINDS = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]")]
#: A name before a separator or a bracket; what addresses stand apart by.
NAME_BEFORE = re.compile(r"[\w\-]+(?=[\"']?\]?\s*(?::|=|\())")
APART = re.compile(r"[\s\"'`]")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
REFERENCE = re.compile(
    r"\$[\w{(]|%\(\w+\)|\{\{|^\{\w*\}$|^<[^<>]*>$|^(?:vault|file|env|ssm|arn|op|secret|keyring|sops|kms|https?|s3|gs)[:/]|"
    r"^(?:~|\.{1,2})?/[\w./~-]*$|^[A-Za-z]:\\|\bprocess\.env|\bos\.environ|^%\w+%$|^!\w+\s"
)
MASK = re.compile(r"(.)\1{5,}")
# What people write where a credential will stand.
FILLERS = frozenset(
    "change changeme your insert replace redacted placeholder example dummy todo tbd fixme sample here fill none null undefined "
    "unset empty default keyring wiki paste masked hidden removed omitted required missing prompt fake mock lorem foobar me set na".split()
)
EMAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?")
WORDY = re.compile(r"^(?:from|see|set|ask|use|in|fill|read|get|stored?|kept|via|not|no|your|the|a|an|to)\b[ _-]", re.I)
#: Shannon entropy in bits a character that random text of each alphabet has; shorter text can't reach it.
ALPHABET_BITS = {"digits": math.log2(10), "hex": 4.0, "letters": math.log2(52), "alnum": math.log2(62), "base64": 6.0, "printable": math.log2(94)}

CANDIDATE = "file_id bigint, start_pos bigint, end_pos bigint, context string, alphabet string, length int, entropy double, excluded string"


def alphabet(v: str) -> str:
    """The smallest of the known alphabets that covers a text."""
    if v.isdigit():
        return "digits"
    if HEX.fullmatch(v):
        return "hex"
    if v.isascii() and v.isalpha():
        return "letters"
    if v.isascii() and v.isalnum():
        return "alnum"
    if BASE64.fullmatch(v):
        return "base64"
    return "printable"


@lru_cache(1 << 16)
def _bits(c: int, n: int) -> float:
    return c / n * math.log2(c / n)


def entropy(v: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(v)
    return -sum([_bits(v.count(ch), n) for ch in dict.fromkeys(v)]) if n else 0.0


def names_credential(name: str) -> bool:
    """Whether a name says that its value is a credential."""
    words = [w.lower() for w in WORDS.findall(name)]
    words = [w for w in words if len(w) > 1]
    if not words or words[-1] in ABOUT:
        return False
    if any(w in STRONG for w in words):
        return True
    flat = "".join(words)
    if flat.endswith(("password", "passwd", "apikey", "secret", "accesstoken")):
        return True
    return "cle" in words and "api" in words or words[-1] in ("key", "keys") and any(w in KEYED for w in words[:-1])


def excluded(v: str, context: str) -> str | None:
    """Why a value is no literal credential, or null."""
    low = v.lower()
    if context == "joined":
        return None
    if len(v) < 4:
        return "short"
    if REFERENCE.search(v):
        return "reference"
    if MASK.search(v) or len(set(v)) < 3:
        return "mask"
    if context == "format":
        return None
    if context == "scheme" and "basic" == low:
        return "name"
    if low == "n/a" or not any(ch.isdigit() for ch in v) and (WORDY.search(v) or FILLERS & set(re.split(r"[^a-z]+", low))):
        return "placeholder"
    if names_credential(v) and PHRASE.fullmatch(v) and (low == v or v.isupper() or "_" in v or "-" in v):
        return "name"
    if context == "listed" and not (any(ch.isdigit() for ch in v) and any(ch.isalpha() for ch in v) and len(v) >= 8):
        return "word"
    if context == "listed" and EMAIL.fullmatch(v):
        return "name"
    if context in ("listed", "unnamed") and (UUID.fullmatch(v) or DIGEST.match(low)):
        return "digest"
    if context == "prose" and (v.isalpha() and (v.islower() or v.istitle()) or v.endswith((":", "=", "(")) or HOST.fullmatch(v)):
        return "word"
    return None


def _line_spans(text: str, a: int, b: int, low: str, formats: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, context) of the candidates of the line text[a:b]; low is the line in lower case, formats whether the
    text holds one of FORMAT_SIGNS."""
    line = text[a:b]
    if formats:
        for m in FORMAT.finditer(line):
            yield a + m.start(), a + m.end(), "format"
    if "://" in line:
        for m in URL_USER.finditer(line):
            yield a + m.start("v"), a + m.end("v"), "url"
    if "basic" in low or "bearer" in low or "authorization" in low:
        for m in SCHEME.finditer(line):
            if m["s"].lower() != "token" or "authorization" in low:
                yield a + m.start("v"), a + m.end("v"), "scheme"
    if "=" in line and ("?" in line or ";" in line or "&" in line):
        for m in QUERY.finditer(line):
            if names_credential(m["name"]) or m["name"] in ("sig", "key", "auth"):
                yield a + m.start("v"), a + m.end("v"), "query"
    if "env" in line or "${" in line:
        for m in FALLBACK.finditer(line):
            if names_credential(m["a"] or m["b"] or m["c"]):
                yield a + m.start("v"), a + m.end("v"), "named"
    if "-u" in line:
        for m in PAIR.finditer(line):
            yield a + m.start("v"), a + m.end("v"), "pair"
    if "sshpass" in low:
        for m in SSHPASS.finditer(line):
            yield a + m.start("v"), a + m.end("v"), "flag"
    if "--" in line:
        for m in FLAG.finditer(line):
            if names_credential(m["name"]):
                yield a + m.start("v"), a + m.end("v"), "flag"
    if "pass" in low or "secret" in low:
        for m in PROSE.finditer(line):
            v = m["v"].rstrip(".") if not line[m.end("v") :].strip(" \"'") else m["v"]
            yield a + m.start("v"), a + m.start("v") + len(v), "prose"
    if "=" in line or ":" in line:
        for m in NAMED.finditer(line):
            name = m["name"].rpartition(".")[2] or m["name"]
            if names_credential(name):
                yield from _values(text, a, b, m)
            elif not m["open"] and (words := WORDS.findall(name)) and words[-1].lower() in SEVERAL:
                yield from _listed(text, a, b, m)


def _listed(text: str, a: int, b: int, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The literals of a bracketed list, or of the dashes below a name that ends its line."""
    at = a + m.end()
    rest = text[at:b].strip()
    if rest[:1] in ("[", "{", "("):
        depth, calls = 0, 0
        found = []
        for x in IN_LIST.finditer(text, text.index(rest[0], at)):
            if x["o"]:
                depth += 1
                if calls or text[x.start() - 1].isalnum() or text[x.start() - 1] == "_":
                    calls += 1  # arguments and subscripts aren't items
            elif x["c"]:
                depth -= 1
                calls = max(0, calls - 1)
                if depth == 0:
                    yield from found
                    return
            elif x["s"] and not calls:
                s, e = x.start() + 1, x.end() - 1
                if re.match(r"\s*(?::|=>)", text[x.end() : x.end() + 16]):
                    continue  # a key
                key = LIST_NAME.search(text, max(0, x.start() - 80), x.start())
                words = WORDS.findall(key["name"]) if key else []
                if not words or words[-1].lower() not in ABOUT:
                    found.append((s, e, "listed"))
    elif (not rest or rest[0] == "#") and m[0].rstrip().endswith(":") and not text[a : a + m.start()].strip(" \t\"'-"):
        indent = len(text[a:b]) - len(text[a:b].lstrip())
        for s, e in _lines_after(text, b):
            line = text[s:e]
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            x = LIST_ITEM.fullmatch(line.rstrip())
            if not line.lstrip().startswith("-") or len(line) - len(line.lstrip()) < indent:
                return
            if x and not (x["b"] or "").endswith(":") and not (x["b"] and ": " in line):
                g = "v" if x["v"] is not None else "b"
                yield s + x.start(g), s + x.end(g), "listed"


def _lines_after(text: str, b: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines after the one that ends at b."""
    while b < len(text):
        s = b + (2 if text.startswith("\r\n", b) else 1)
        e = text.find("\n", s)
        e = len(text) if e < 0 else e
        b = e
        yield s, e - (e > s and text[e - 1] == "\r")


def _below(text: str, a: int, b: int, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The value of a name that stands below it: a string on the next line, a deeper plain or block scalar."""
    rest = text[a + m.end() : b].strip()
    key = m[0].rstrip().endswith(":")
    if key and text[a : a + m.start()].strip(" \t\"'-"):
        return  # a statement that ends with a colon
    indent = len(text[a:b]) - len(text[a:b].lstrip())
    first = last = None
    for s, e in _lines_after(text, b):
        line = text[s:e].rstrip()
        start = s + len(line) - len(line.lstrip())
        if rest in ("", "\\") and line.strip():
            if line.lstrip()[0] in "\"'`" and not (key and re.match(r"\s*([\"']).*?\1\s*:", line)):
                yield from _joined(text, start)
            elif key and start - s > indent and re.fullmatch(r"\s*[^\s#\[{&*!|>-][^\s#]*(?<!:)", line) and re.search(r"\d", line) and not re.search(r"[(){}=]", line):
                yield start, s + len(line), "bare"
            return
        if rest not in ("", "\\"):
            if line.strip() and start - s <= indent:
                break
            if line.strip():
                if " " in line.strip():
                    return
                first, last = start if first is None else first, s + len(line)
        elif not line.strip():
            return
    if first is not None:
        yield first, last, "named"


def _random(v: str) -> bool:
    """Whether letters and digits change in a token as often as they do at random."""
    return sum(ch.isdigit() for ch in v) >= 2 and any(ch.isalpha() for ch in v) and len(CHANGES.findall(v)) >= 0.3 * len(v)


def _what(v: str) -> tuple[str, str | None]:
    """Context (unnamed, or prefixed where a key's own name stands before its random part) of a literal that nothing on
    its line explains, and why it is none by its form."""
    if HEX.fullmatch(v) or UUID.fullmatch(v) or DIGEST_NAME.match(v.lower()):
        return "unnamed", "digest"
    if (m := PREFIXED.fullmatch(v)) and not (DATA | ABOUT) & {w.lower() for w in (m["words"] or m["word"]).split("_")}:
        part = m["part"] or m["parts"].replace("-", "")
        if m["part"] and "_" in m["words"] and HEX.fullmatch(part) and any(ch.isalpha() for ch in part) or not HEX.fullmatch(part) and (_random(part) or len(CHANGES.findall(part)) >= 0.3 * len(part)):
            return "prefixed", None
    if SIGNS.sub("", v) == v or TOKEN.fullmatch(v):
        return "unnamed", None if len(v) >= 20 and _random(v) else "words"
    kinds = sum(bool(x.search(v)) for x in KINDS)
    if STRUCTURE.search(v) or HOST.fullmatch(v) or EMAIL.search(v):
        return "unnamed", "structure"
    signs = len(SIGNS.findall(v))
    return "unnamed", None if kinds == 3 and 2 <= signs <= len(v) // 3 and len(CHANGES.findall(v)) + signs >= 0.5 * len(v) else "words"


def _unnamed(text: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, context, why it is none) of every quoted string and long token of a text."""
    pems = None
    last = -1
    spans = sorted({m.span("v") for m in STRING.finditer(text)} | {m.span() for m in LONG.finditer(text)})
    for s, e in spans:
        if s < last:
            continue  # a token within a string
        last = e
        v = text[s:e]
        context, why = _what(v)
        if why:
            yield s, e, context, why
            continue
        a = text.rfind("\n", 0, s) + 1
        b = text.find("\n", e)
        line, before = text[a : len(text) if b < 0 else b], text[a:s]
        bare = line.strip(_AROUND)
        if bare == v.strip(_AROUND):
            # A token that fills its line: wrapped data if a line beside it is filled as well, else named by the line before.
            prev = text[text.rfind("\n", 0, max(0, a - 1)) + 1 : max(0, a - 1)]
            after = text[b + 1 :].split("\n", 1)[0] if b >= 0 else ""
            if any(LONG.fullmatch(x.strip(_AROUND)) for x in (prev, after)) or "-----" in prev + after:
                why = "data"
            before = prev
        names = [w.lower() for n in NAME_BEFORE.findall(before)[-1:] for w in WORDS.findall(n)]
        if DATA_BEFORE.search(before[-NEAR:]) or "://" in APART.split(before)[-1] or names and (context == "unnamed" and names[-1] in ABOUT or DATA & set(names)):
            why = "data"
        if why is None:
            if pems is None:
                pems = [x.span() for x in PEM.finditer(text)] if "-----BEGIN " in text else []
            if any(x < e and s < y for x, y in pems):
                why = "data"
        yield s, e, context, why


def _joined(text: str, at: int) -> Iterator[tuple[int, int, str]]:
    """A quoted literal and those it is put together with; parts after the first may be short."""
    context = "named"
    q3 = text[at : at + 3]
    if q3 in ('"""', "'''"):
        end = text.find(q3, at + 3)
        v = text[at + 3 : end].strip() if end >= 0 else ""
        if v and not re.search(r"\s", v):
            s = text.index(v, at + 3)
            yield s, s + len(v), context
        return
    while q := QUOTED.match(text, at):
        yield q.start("v"), q.end("v"), context
        if excluded(q["v"], context):
            return
        more = MORE.match(text, q.end())
        if not more or more.end() == q.end():
            return
        at, context = more.end(), "joined"


def _values(text: str, a: int, b: int, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The literals on the right side of a named value."""
    at = a + m.end()
    if m["open"]:
        yield from _joined(text, at - len(m["open"].lstrip("bBrRuUfF")))
        return
    rest = text[at:b]
    if m[0].endswith(":") and not m["close"] and not rest.startswith((" ", "\t")):
        return  # name:value within a string is a scope, a tag or a time
    if rest.strip() in ("", "\\") or BLOCK_SCALAR.fullmatch(rest):
        yield from _below(text, a, b, m)
    if not rest.strip() or rest[0] in "[{#(":
        yield from _listed(text, a, b, m)
        return
    if rest[0] in "|>&*\\":
        return
    if inner := CALL.match(rest):
        found = list(QUOTED.finditer(text, at + inner.end(), b))
        head = rest[: inner.end()]
        coded = "64" in head or "atob" in head or "Buffer" in head
        if "env" in head and not head.startswith("process"):
            found = found[1:]
        for q in found[:1]:
            yield q.start("v"), q.end("v"), "coded" if coded else "named"
        return
    if re.match(r"[A-Za-z_][\w.]*\s*[(\[]", rest):
        return
    if v := re.match(r"[^\s#,;)\]}\"'`][^\s,;)\]}\"'`]*", rest):
        bare, line = v[0], text[a:b]
        plain_name = re.fullmatch(r"[A-Za-z_][\w.]*", bare)
        shell = line.lstrip().startswith(("export ", "set ")) or ":" in m[0] or "=" in m[0] and " " not in line.strip()
        if not plain_name or re.search(r"\d", bare) or shell:
            yield at, at + v.end(), "bare"


def _lower(text: str) -> str:
    """Lower case of the ASCII letters only, so that positions stay."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def hinted_lines(low: str) -> list[tuple[int, int]]:
    """(start, end) of the lines in which one of HINTS occurs."""
    starts: dict[int, int] = {}
    for w in [w for w in HINTS if w in low]:
        i = low.find(w)
        while i >= 0:
            skip, needs = SKIP.get(w), NEEDS.get(w)
            if skip and skip.match(low, i) or needs and not needs.search(low[max(0, i - 12) : i]):
                i = low.find(w, i + len(w))
                continue
            a = max(low.rfind("\n", 0, i), low.rfind("\r", 0, i)) + 1
            b = low.find("\n", i)
            b = len(low) if b < 0 else b
            c = low.find("\r", i, b)
            b = b if c < 0 else c
            starts[a] = b
            i = low.find(w, b)
    return sorted(starts.items())


def candidates(text: str) -> list[tuple[int, int, str, str | None]]:
    """Spans that may be credentials, with their context and, for literals that nothing on their line explains, why they are
    none; overlapping ones are resolved to the narrowest, and what a context explains is looked at in that one only."""
    out: dict[tuple[int, int], str] = {}
    listed: list[tuple[int, int]] = []
    low = _lower(text)
    blocks = [m.span() for m in KEY_BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    formats = any(w in text for w in FORMAT_SIGNS)
    for a, b in hinted_lines(low):
        if any(s <= a and b <= e for s, e in blocks):
            continue
        for s, e, c in _line_spans(text, a, b, low[a:b], formats):
            if c == "listed":
                listed.append((s, e))
            elif e > s and (out.get((s, e)) is None or c == "format"):
                out[s, e] = c
    if "value" in text and "name" in text:
        for m in ITEM.finditer(text):
            if names_credential(m["n"]):
                at = m.start("rest")
                if q := QUOTED.match(text, at):
                    out.setdefault((q.start("v"), q.end("v")), "named")
                elif v := re.match(r"[^\s#,\]}\"']+", m["rest"]):
                    out.setdefault((at, at + v.end()), "bare")
    if "@" in text:
        for m in TUPLE.finditer(text):
            out.setdefault(m.span("v"), "named")
    if "= (" in text:
        for m in SPREAD.finditer(text):
            if names_credential(m["name"]):
                at = m.start("body")
                at += len(text[at : m.end("body")]) - len(text[at : m.end("body")].lstrip())
                for s, e, c in _joined(text, at):
                    out.setdefault((s, e), c)
    for s, e in listed:
        if e > s:
            out.setdefault((s, e), "listed")
    spans = [(s, e, c) for (s, e), c in out.items() if not any(x < e and s < y for x, y in blocks)]
    spans += [(s, e, "block") for s, e in blocks]
    # A span that holds another one is a wrapper (a URL, a header, a whole document).
    kept: list[tuple[int, int, str, str | None]] = []
    for x in sorted(spans, key=lambda x: (x[2] != "format", x[1] - x[0])):
        if not any(x[0] < k[1] and k[0] < x[1] for k in kept):
            kept.append((*x, None))
    kept += [u for u in _unnamed(text) if not any(u[0] < y and x < u[1] for x, y, _ in spans)]
    return sorted(kept, key=lambda x: x[:2])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for fid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            found = candidates(text)
            for i, (s, e, c, why) in enumerate(found):
                v = text[s:e]
                whole = v
                if c == "joined" or i + 1 < len(found) and found[i + 1][2] == "joined":
                    # Parts of one literal are judged by what they make together.
                    first, end = i, i + 1
                    while found[first][2] == "joined":
                        first -= 1
                    while end < len(found) and found[end][2] == "joined":
                        end += 1
                    whole = "".join(text[x[0] : x[1]] for x in found[first:end])
                row = (fid, s, e, c, alphabet(whole), len(whole), entropy(whole), why or (None if c in ("block", "joined", "prefixed") else excluded(v, c)))
                for col, x in zip(cols, row):
                    col.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string()]
        names = ["file_id", "start_pos", "end_pos", "context", "alphabet", "length", "entropy", "excluded"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def credential_candidates(files: DataFrame) -> DataFrame:
    """Candidate rows of ``file_id, text``: span, context, alphabet, length, entropy and why it is excluded."""
    return files.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).select(F.col("file_id").cast("bigint"), "text").mapInArrow(_rows, CANDIDATE)


def threshold() -> Column:
    """Bits a character that a candidate must reach: a share of what random text of its alphabet and length would
    have; the share is smaller where the context names a credential."""
    full = None
    for k, bits in ALPHABET_BITS.items():
        hit = F.col("alphabet") == k
        full = F.when(hit, bits) if full is None else full.when(hit, bits)
    reachable = F.least(full, F.log2(F.col("length").cast("double")))
    share = F.when(F.col("context").isin("named", "joined", "flag", "pair", "url", "query", "bare", "prose"), 0.4).otherwise(0.6)
    return reachable * F.when(F.col("context") == "unnamed", 0.85).otherwise(share)


def credentials(found: DataFrame) -> DataFrame:
    """``file_id, start_pos, end_pos`` of the candidates that are credentials."""
    hit = (F.col("context") == "block") | (F.col("excluded").isNull() & (F.col("entropy") >= threshold()))
    return found.where(hit).select("file_id", "start_pos", "end_pos")


def redact(files: DataFrame, found: DataFrame, mark: str = "*") -> DataFrame:
    """``file_id, text``: every credential replaced by as many marks, line ends within it kept; all else unchanged."""
    spans = found.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("spans"))
    pairs = files.select("file_id", "text").join(spans, "file_id", "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        plain = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start_pos"] - acc["at"]).cast("int"))
        secret = F.substring(F.col("text"), (s["start_pos"] + 1).cast("int"), (s["end_pos"] - s["start_pos"]).cast("int"))
        return F.struct(F.concat(acc["done"], plain, F.regexp_replace(secret, r"[^\r\n]", mark)).alias("done"), s["end_pos"].alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    return pairs.select("file_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, finish)).alias("text"))
