"""Rule tables: what the scanners and policies look for.

Rules are data. The tables here are general ones; :func:`line_rules`, :func:`policy_rules`, :func:`combination_rules` and
:func:`names` read others from a table or file of any size-checked format, and every operator takes those as well.

Patterns use only what Java's and RE2's regular expressions share and hold no capturing group. A rule may name a literal
that a matching line must hold (in lower case where the pattern begins with ``(?i)``), so that most lines are passed over
by a substring test.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: A rule table holds at most this many rows; it becomes part of the plan and may be broadcast.
MAX_RULES = 10_000


@dataclass(frozen=True)
class LineRule:
    """A pattern on lines; rules of one table are ordered."""

    rule_id: str
    table: str
    ord: int
    literal: str
    pattern: str
    severity: str  # "info" rules claim their line for their table and give no finding
    category: str
    action: str
    once: str = "file"  # a finding per match ("match"), per file ("file") or per file and rule ("rule")
    scoped: bool = False  # the scope is the first quoted text after the match if it is a URL or a path from the root


def _read(frame: DataFrame, *columns: str) -> list:
    rows = frame.select(*columns).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold {MAX_RULES} rows")
    return rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A rule file as a DataFrame: JSON lines (``.json``, ``.jsonl``), CSV with a head line (``.csv``), else Parquet."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def line_rules(frame: DataFrame) -> list[LineRule]:
    """Rules from ``rule_id, pattern`` and, where there, ``table, ord, literal, severity, category, action, once, scoped``.

    Rows without a rule_id or pattern are left out, further columns ignored; rules of a table are ordered by ord (nulls
    last), then by rule_id. A pattern that is no regular expression, or holds a capturing group, is an error.
    """
    have = [c for c in ("rule_id", "pattern", "table", "ord", "literal", "severity", "category", "action", "once", "scoped") if c in frame.columns]
    out = []
    for r in _read(frame, *have):
        v = {k: x for k, x in r.asDict().items() if x is not None}
        if "rule_id" in v and "pattern" in v:
            if re.compile(v["pattern"]).groups:
                raise ValueError(f"rule {v['rule_id']}: capturing group")
            out.append(LineRule(**{"table": "", "ord": MAX_RULES, "literal": "", "severity": "restricted", "category": "", "action": "", "once": "rule"} | v))
    return sorted(out, key=lambda r: (r.table, r.ord, r.rule_id))


def policy_rules(frame: DataFrame) -> list[tuple]:
    """(rule, action, capability, globs, priority) in the order of ``ord, rule_id``, from columns of these names."""
    rows = [r for r in _read(frame, "ord", "rule_id", "decision", "capability", "globs", "priority") if r.rule_id and r.decision and r.capability]
    return [(r.rule_id, r.decision, r.capability, [g for g in r.globs or [] if g], r.priority or 0) for r in sorted(rows, key=lambda r: (MAX_RULES if r.ord is None else r.ord, r.rule_id))]


def combination_rules(frame: DataFrame) -> list[tuple]:
    """(rule, severity, capabilities, needs a binary that isn't allowed, risk) from ``rule_id, severity, capabilities, needs, risk``."""
    rows = [r for r in _read(frame, "rule_id", "severity", "capabilities", "needs", "risk") if r.rule_id and r.capabilities]
    return sorted((r.rule_id, r.severity or "medium", sorted(set(r.capabilities)), bool(r.needs), r.risk or 0) for r in rows)


def names(frame: DataFrame, column: str) -> list[str]:
    """Distinct texts of a column in order: binaries, module names, globs."""
    return sorted({r[0] for r in _read(frame, column) if r[0]})


def _table(table: str, severity: str, rows: list[tuple], once: str) -> list[LineRule]:
    return [LineRule(f"{table}-{r[0]}", table, i, r[1], r[2], severity, r[3], r[4], once, *r[5:]) for i, r in enumerate(rows)]


def _words(table: str, words: str, category: str, action: str, once: str = "file", fold: str = "") -> list[LineRule]:
    """Rules for commands by name, then for names that are compared without case."""
    rows = [(w, w, rf"\b{re.escape(w)}\b", category, action) for w in words.split()]
    rows += [(w, w.lower(), rf"(?i)\b{re.escape(w)}\b", category, action) for w in fold.split()]
    return _table(table, "restricted", rows, once)


SHELL_PROHIBITED = _table(
    "sh-deny",
    "prohibited",
    [
        ("pipe-to-shell", "|", r"(?i)\b(?:curl|wget)\s.*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b", "subprocess", "exec"),
        ("substitution-to-shell", "`", r"(?i)`[^`]+`\s*\|\s*(?:ba)?sh\b", "subprocess", "exec"),
        ("eval", "eval", r"\beval\s+[\"'$(]", "subprocess", "exec"),
        ("invoke-expression", "", r"(?i)\b(?:invoke-expression\b|iex\s)", "subprocess", "exec"),
        ("source-stdin", "/dev/stdin", r"\bsource\s+/dev/stdin", "subprocess", "exec"),
        ("decode-to-shell", "base64", r"(?i)base64\s+(?:-d|--decode)\b.*\|\s*(?:(?:ba)?sh|python|perl|ruby|node)", "subprocess", "exec"),
        ("inline-code", "-", r"\b(?:python[23]?\s+-c|perl\s+-e|ruby\s+-e|node\s+-e)\s+[\"']", "subprocess", "exec"),
        ("listener", "-", r"(?i)\b(?:nc|ncat|netcat)\b.*-[elp]", "network", "listen"),
        ("reverse-shell", "/dev/tcp/", r"/dev/tcp/", "network", "connect"),
        ("world-writable", "chmod", r"\bchmod\s+(?:-R\s+)?(?:0?777|0?666|a\+rwx)\b", "fs", "write"),
        ("fetch-and-run", "&&", r"(?i)\b(?:curl\s.*-o|wget\s.*-O)\s+\S+\s*&&\s*(?:ba)?sh\s", "subprocess", "exec"),
        ("remove-root", "rm", r"\brm\s+-[a-z]*r[a-z]*\s+/(?:$|\s|\*)", "fs", "delete"),
        ("raw-device", "/dev/", r"\bof=/dev/[a-z]+", "fs", "write"),
    ],
    "match",
)
# Names of common commands by what they can do.
SHELL_NETWORK = _words("sh-net", "curl wget ssh scp rsync nc netcat socat ftp sftp telnet nslookup dig ping tcpdump nmap iptables netstat ss", "network", "connect", fold="Invoke-WebRequest iwr Invoke-RestMethod irm Test-Connection Test-NetConnection")
SHELL_WRITE = _words("sh-write", "rm mv cp mkdir chmod chown touch ln tar unzip zip sed awk dd tee shred truncate mkfifo install", "fs", "write")
SHELL_WRITE += [LineRule("sh-write-redirect", "sh-write", len(SHELL_WRITE), ">", r">+\s*\S", "restricted", "fs", "write")]
SHELL_READ = _words("sh-read", "cat head tail less more find ls wc stat file du df readlink realpath md5sum sha256sum", "fs", "read", fold="Get-Content Get-ChildItem Get-Item Test-Path Select-String")
SHELL_EXEC = _words("sh-exec", "sudo docker kubectl aws gcloud az terraform ansible helm npm npx yarn pnpm pip pip3 python python3 node ruby perl java go cargo make cmake gcc git systemctl service crontab nohup xargs jq psql mysql", "subprocess", "exec", "rule")
SHELL_SECRET = _table("sh-secret", "restricted", [("name", "$", r"\$\{?[A-Z_]*(?:PASSWORD|SECRET|TOKEN|API_KEY|CREDENTIALS|PRIVATE_KEY)", "secret", "access")], "file")
SHELL_ENV = _table("sh-env", "restricted", [("export", "export", r"\bexport\s+[A-Za-z_]", "env", "write"), ("dump", "", r"\b(?:printenv\b|env\s*(?:$|\|)|set\s*$|docker\s+inspect\b)", "env", "read")], "file")


def _module(names_: str) -> str:
    """A pattern of ``require("m")`` or ``from "m"`` for any of some modules."""
    return r"(?:\brequire\s*\(\s*|\bfrom\s+)['\"](?:" + "|".join(map(re.escape, names_.split())) + r")['\"]"


JS_PROHIBITED = _table(
    "js-deny",
    "prohibited",
    [
        ("eval", "eval", r"\beval\s*\(", "subprocess", "exec"),
        ("function", "Function", r"\bnew\s+Function\s*\(", "subprocess", "exec"),
        ("exec-template", "child_process", r"\bchild_process\s*[.\[\]'\"]+\s*exec\s*\(\s*`", "subprocess", "exec"),
        ("exec-joined", ".exec", r"\.exec\s*\(\s*[A-Za-z_]\w*\s*\+", "subprocess", "exec"),
        ("vm", "runIn", r"\bvm\s*\.\s*runIn(?:New)?Context\s*\(", "subprocess", "exec"),
        ("require-variable", "require", r"\brequire\s*\(\s*[A-Za-z_]\w*\s*[+)]", "subprocess", "exec"),
    ],
    "match",
)
JS_NETWORK = _table(
    "js-net",
    "restricted",
    [
        ("fetch", "fetch", r"\bfetch\s*\(", "network", "connect", True),
        ("axios", "axios", r"\baxios\s*(?:\.\s*(?:get|post|put|patch|delete|request|head|options)\s*)?\(", "network", "connect", True),
        ("request", "http", r"\bhttps?\s*\.\s*(?:request|get|createServer)\s*\(", "network", "connect", True),
        ("socket", "net", r"\bnet\s*\.\s*(?:connect|createConnection|createServer)\s*\(", "network", "connect", True),
        ("websocket", "WebSocket", r"\bnew\s+WebSocket\s*\(", "network", "connect", True),
        ("xhr", "XMLHttpRequest", r"\bXMLHttpRequest\b", "network", "connect", True),
        ("got", "got", r"\bgot\s*\.\s*(?:get|post|put|patch|delete|head)\s*\(", "network", "connect", True),
        ("database", "", r"\bnew\s+(?:Pool|Client|Sequelize|PrismaClient)\s*\(|\b(?:MongoClient|mongoose)\s*\.\s*connect\s*\(", "network", "connect", True),
        ("module", "", _module("axios node-fetch got superagent pg mysql mysql2 mongodb redis mongoose sequelize knex @prisma/client"), "network", "connect", True),
    ],
    "file",
)
JS_FS = _table(
    "js-fs",
    "restricted",
    [
        ("read", "fs", r"\bfs(?:Promises)?\s*\.\s*(?:readFile|readFileSync|readdir|readdirSync|stat|statSync|access|accessSync|existsSync|createReadStream)\s*\(", "fs", "read"),
        ("write", "fs", r"\bfs(?:Promises)?\s*\.\s*(?:writeFile|writeFileSync|appendFile|appendFileSync|mkdir|mkdirSync|createWriteStream|rename|renameSync|copyFile|copyFileSync)\s*\(", "fs", "write"),
        ("delete", "fs", r"\bfs(?:Promises)?\s*\.\s*(?:unlink|unlinkSync|rmdir|rmdirSync|rm|rmSync)\s*\(", "fs", "delete"),
        ("module", "fs", _module("fs fs/promises node:fs node:fs/promises"), "fs", "read"),
        ("home", ".join", r"\bpath\s*\.\s*join\s*\([^)]*['\"]\.(?:ssh|aws|gnupg|kube|config|netrc|gitconfig)['\"]", "fs", "read"),
    ],
    "file",
)
JS_EXEC = _table("js-exec", "restricted", [("call", "", r"\b(?:exec|execSync|spawn|spawnSync|fork|execFile|execFileSync)\s*\(", "subprocess", "exec"), ("module", "", _module("child_process node:child_process shelljs"), "subprocess", "exec")], "file")
JS_BROWSER = _table("js-browser", "restricted", [("launch", "puppeteer", r"\bpuppeteer\s*\.\s*launch\s*\(", "browser", "control"), ("module", "", _module("puppeteer playwright @playwright/test selenium-webdriver cheerio jsdom"), "browser", "control")], "file")
JS_SECRET = _table("js-secret", "restricted", [("env", "process", r"\bprocess\s*\.\s*env\b", "secret", "access"), ("config", "", r"\bdotenv\s*\.\s*config\s*\(|\bAWS\s*\.\s*config\s*\.\s*credentials", "secret", "access"), ("module", "", _module("dotenv aws-sdk keytar"), "secret", "access")], "file")
JS_CRYPTO = _table(
    "js-crypto",
    "restricted",
    [
        ("sign", "", r"\bcrypto\s*\.\s*(?:createSign|sign)\s*\(|\bjwt\s*\.\s*(?:sign|verify)\s*\(", "crypto", "sign"),
        ("encrypt", "crypto", r"\bcrypto\s*\.\s*(?:createCipher|createCipheriv|publicEncrypt)\s*\(", "crypto", "encrypt"),
        ("hash", "crypto", r"\bcrypto\s*\.\s*(?:createHash|createHmac)\s*\(", "crypto", "hash"),
        ("module", "", _module("crypto node:crypto bcrypt"), "crypto", "hash"),
    ],
    "file",
)
JS_SERIAL = _table("js-serial", "info", [("json", "JSON", r"\bJSON\s*\.\s*parse\s*\(", "serial", "deserialize")], "file")
JS_SERIAL += [LineRule("js-serial-vm", "js-serial", 1, "runIn", r"\bvm\s*\.\s*runIn(?:New|This)?Context\s*\(", "restricted", "serial", "deserialize")]
PY_RULES = _table(
    "py",
    "restricted",
    [
        ("subprocess", "subprocess.", r"\bsubprocess\.(?:run|call|Popen|check_call|check_output)\s*\(", "subprocess", "exec"),
        ("system", "os.", r"\bos\.(?:system|popen|exec[lv]p?e?|spawn[lv]p?e?)\s*\(", "subprocess", "exec"),
        ("requests", "requests.", r"\brequests\.(?:get|post|put|patch|delete|head|request)\s*\(", "network", "connect"),
        ("urlopen", "urlopen", r"\burlopen\s*\(", "network", "connect"),
        ("session", "session.", r"\bsession\.(?:get|post|put|patch|delete|request)\s*\(", "network", "connect"),
        ("environ", "os.", r"\bos\.(?:environ\b|getenv\s*\()", "env", "read"),
        ("open", "open(", r"\bopen\(", "fs", "read"),
        ("remove", "", r"\b(?:os\.(?:remove|unlink|rmdir)|shutil\.rmtree)\s*\(", "fs", "delete"),
        ("hash", "hashlib", r"\bhashlib\.\w+", "crypto", "hash"),
        ("unpickle", "", r"\b(?:pickle|marshal|shelve|dill)\.(?:loads?|open)\s*\(", "serial", "deserialize"),
        ("eval", "", r"\b(?:eval|exec)\s*\(", "subprocess", "exec"),
    ],
    "rule",
)
#: Ordered tables of rules by language; the first pattern of a table that matches a line counts.
SCANS: dict[str, list[list[LineRule]]] = {
    "shell": [SHELL_NETWORK, SHELL_WRITE, SHELL_READ, SHELL_EXEC, SHELL_SECRET, SHELL_ENV],
    "javascript": [JS_NETWORK, JS_FS, JS_EXEC, JS_BROWSER, JS_SECRET, JS_CRYPTO, JS_SERIAL],
    "python": [PY_RULES],
}
PROHIBITED: dict[str, list[LineRule]] = {"shell": SHELL_PROHIBITED, "javascript": JS_PROHIBITED}

#: Lines of Dockerfiles.
DOCKER = _table(
    "docker",
    "restricted",
    [
        ("user-root", "USER", r"^\s*USER\s+(?:root|0)(?::|\s|$)", "system", "privilege"),
        ("add-url", "ADD", r"^\s*ADD\s+(?:--[a-z]+=\S+\s+)*https?://", "network", "connect"),
        ("admin-port", "EXPOSE", r"^\s*EXPOSE\s.*\b(?:22|23|2375|3306|5432|6379|27017)(?:/|\s|$)", "network", "listen"),
        ("latest", "FROM", r"^\s*FROM\s+\S+:latest(?:\s|$)", "system", "supply"),
        ("secret-env", "=", r"^\s*(?:ENV|ARG)\s+[A-Z_]*(?:PASSWORD|SECRET|TOKEN|API_KEY)[A-Z_]*=\S", "secret", "access"),
        ("host-mount", "VOLUME", r"^\s*VOLUME\s.*(?:/etc|/root|/var/run/docker\.sock|/proc)", "fs", "read"),
        ("privileged", "--privileged", r"--privileged", "system", "privilege"),
    ],
    "rule",
)

#: Persuasion in prose, comments and strings, in order; a line counts for one rule, a rule once in a file.
_URGENT = r"\b(?:urgent|urgently|immediately|right\s+now|fix\s+this|quick\s+fix|asap)\b"
_SHELL = r"\b(?:terminal|console|shell|command\s+line|cmd)\b"
_PASTE = r"\bpaste\s+(?:this|it|the\s+following)\b"
_UPDATE = r"\b(?:security\s+update|critical\s+update|emergency\s+patch)\b"
_RUN = r"\b(?:run|execute|install)\b"
PERSUASION = _table(
    "persuade",
    "restricted",
    [
        ("urgent-sudo", "sudo", rf"(?i)\bsudo\b.*{_URGENT}|{_URGENT}.*\bsudo\b", "social", "instruct"),
        ("paste", "paste", rf"(?i){_PASTE}.*{_SHELL}|{_SHELL}.*{_PASTE}", "social", "instruct"),
        ("pipe-to-shell", "|", r"(?i)\b(?:curl|wget)\s+\S+\s*\|\s*(?:ba)?sh", "social", "instruct"),
        ("run-as-root", "run", r"(?i)\brun\s+(?:this\s+)?(?:as\s+)?(?:root|administrator|admin)\b", "social", "privilege"),
        ("fake-update", "", rf"(?i){_UPDATE}.*{_RUN}|{_RUN}.*{_UPDATE}", "social", "authority"),
        ("disarm", "", r"(?i)\b(?:disable|turn\s+off|deactivate)\s+(?:your\s+)?(?:antivirus|firewall|defender|protection|security)\b", "social", "disarm"),
        ("open-permissions", "chmod", r"\bchmod\s+777\b", "social", "instruct"),
    ],
    "rule",
)

#: (rule, severity, capabilities that must all be there, needs a binary that isn't allowed, least risk)
COMBINATIONS = [
    ("exfiltrate-secret", "critical", ["network:connect", "secret:access"], False, 90),
    ("run-download", "critical", ["network:connect", "subprocess:exec"], True, 85),
    ("store-download", "high", ["fs:write", "network:connect"], False, 60),
    ("decode-and-run", "high", ["serial:deserialize", "subprocess:exec"], False, 75),
    ("environment-to-net", "medium", ["env:read", "network:connect"], False, 50),
    ("hash-only", "low", ["crypto:hash"], False, 5),
]
# Programs that open a way in or give rights, and harmless ones.
DENIED_BINARIES = "nc ncat netcat nmap socat telnet tcpdump mimikatz hydra sqlmap john hashcat msfconsole sudo su chroot nsenter".split()
ALLOWED_BINARIES = "git jq gzip tar ls cat head tail grep sed awk sort uniq wc find echo date".split()
DENIED_PATHS = ["/etc/*", "/root/*", "/proc/*", "/sys/*", "/boot/*", "/var/run/docker.sock", "~/.ssh/*", "~/.aws/*", "~/.gnupg/*", "~/.kube/*", "*.pem", "*.key", "*id_rsa*", "*/secrets/*", "*vault*", "*/.env", "[!a-z]*"]
#: (rule, action, capability, globs, priority)
POLICY = [
    ("no-exec-of-denied", "deny", "subprocess:exec", DENIED_BINARIES, 50),
    ("no-open-exec", "deny", "subprocess:exec", ["[*]"], 10),
    ("tools", "allow", "subprocess:exec", [*ALLOWED_BINARIES, "*tool"], 5),
    ("examples", "allow", "network:connect", ["*.example", "*.example/*"], 1),
    ("invalid-hosts", "deny", "network:connect", ["*.invalid", "*.onion"], 20),
    ("json-reads", "allow", "fs:read", ["*.json", "?ocs/*"], 1),
    ("watch-env", "flag", "env:read", ["*"], 99),
]
#: Words of kinds of texts and code.
KEYWORDS = {
    "integrity": ["checksum", "sha256", "merkle", "signature", "certificate", "lockfile", "verify"],
    "network": ["http", "download", "request", "endpoint", "proxy", "webhook", "socket"],
    "review": ["review", "approve", "comment", "maintainer", "feedback", "finding"],
    "shell": ["bash", "command", "script", "terminal", "subprocess", "cron"],
    "policy": ["policy", "allow", "deny", "denies", "permission", "rule", "compliance"],
    "data": ["csv", "parquet", "database", "query", "table", "dataset", "pipeline"],
    "release": ["release", "version", "changelog", "upgrade", "deprecated", "migration"],
}
#: Categories whose capabilities look out of place for a package's declared category.
UNEXPECTED = {"notes": ["subprocess", "network", "secret"], "web_fetch": ["subprocess", "serial"], "data_pipeline": ["secret"], "devops": ["serial"]}
# The known categories and actions of capabilities.
CATEGORIES = ["fs", "network", "subprocess", "env", "browser", "secret", "crypto", "serial", "concurrency", "system"]
ACTIONS = ["read", "write", "delete", "connect", "listen", "dns", "exec", "spawn", "control", "navigate", "inject", "access", "store", "sign", "encrypt", "hash", "deserialize", "thread", "process", "async", "signal", "sysinfo"]
# Suffixes of files that aren't text, and of source files.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".mp3", ".mp4", ".wav", ".ogg", ".webm", ".avi", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".whl", ".egg", ".pyc", ".pyo", ".so", ".dll", ".dylib", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".lock", ".lockb", ".woff", ".woff2", ".ttf", ".otf", ".eot",
]
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".sh", ".bash", ".bat", ".ps1", ".zsh", ".rb", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".yaml", ".yml", ".toml", ".json", ".cfg", ".ini"]
# Cyrillic and Greek letters that look like Latin ones; characters that have no width.
LOOK_ALIKES = "[АВЕКМНОРСТХаеорсхΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ]"
NO_WIDTH = "[\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u034f\u180e]"
# Paths that a scan leaves out.
IGNORED = ["__pycache__", ".git", ".hg", ".svn", "node_modules", ".venv", "venv", ".env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "*.egg-info", ".eggs", "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll"]


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a shell pattern; ``*`` crosses ``/``, ``~`` stands for /home/user."""
    if glob.startswith("~"):
        glob = "/home/user" + glob[1:]
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inside = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table as a DataFrame; its size is that of the rules, so it may be broadcast."""
    return spark.createDataFrame(rows, schema)
