"""Texts that were cut off: a hashed logistic regression over how they end.

Positives are made by cutting intact texts inside a word or sentence; the rest are texts as they stand. Features
are the closing characters, punctuation, words and line of a text, how often its last words end a line elsewhere
in the corpus, and how far its length piles up at a limit of its source. Fitting takes a bounded sample
(``sample_rows``); corpus counts and scores cover every row. Every training row has the bucket that its length has in
its source. The first fit goes without lengths. The second one leaves out the texts that the first one found to be cut;
half its cuts are made at lengths at which these texts pile up in a source, and rows with and without such a length are
weighed to be as frequent among cuts and whole texts as the first fit found them.

Null and empty texts are never cut. Equal texts of one source get equal scores. A null source counts as one source
of its own. A corpus without any text gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lanternfish.sources.storage import cut as written
from lanternfish.sources.storage import looked_up

DIM = 1 << 15
#: The first indices are kept for the counts that Spark joins to a text.
RESERVED = 256
#: At most about this many labelled rows are used for each fit, in this many parts.
SAMPLE_ROWS = 32_000
FIT_PARTS = 2
OMISSION = re.compile(r"(?:\s*(?:…|\.\.\.|\[\.\.\.\]|\[…\]))+$")
DAMAGE = re.compile(r"(?:�|%[0-9A-Fa-f]{0,2}|&#?\w{0,6}|\\u?[0-9a-fA-F]{0,3}|Ã.?|â€?.?)+$")
SENTENCE_END = re.compile(r"[.!?。][)\"'”»\]]*(?=\s|$)")
LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")
DATE = re.compile(r"\d{4}-\d\d-\d\d")
PAIR = re.compile(r"[\w.-]+:\s\S+")
ASCII_NUMBER = re.compile(r"[0-9]+")
NUMBER = re.compile(r"\d+")
DIGIT = re.compile(r"\d")
UPPER = re.compile(r"[A-Z]")
LOWER = re.compile(r"[a-zà-ÿ]")
REPEATED = re.compile(r"(.)\1+")
HEXADECIMAL = re.compile(r"(?:^|:)([0-9a-f]+)$")


def normal_source(source: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, hyphens; null becomes ''."""
    return F.coalesce(F.translate(F.lower(F.trim(source)), "_ ", "--"), F.lit(""))


def token_form(token: str) -> str:
    """Lower case, digits as 0, without outer punctuation."""
    return ASCII_NUMBER.sub("0", token.lower()).strip(".,;:!?()[]\"'`*…")


def _bare(text: str) -> tuple[str, str]:
    """A text without signs of omission or damage at its end, and which there were."""
    marks = ""
    t = text.rstrip("\n\r")
    if t != t.rstrip():
        marks += "s"
    t = t.rstrip()
    for name, rx in (("o", OMISSION), ("d", DAMAGE), ("o", OMISSION)):
        m = rx.search(t[-40:])
        if m and m.end() > m.start():
            at = len(t) - len(t[-40:]) + m.start()
            if at and (name == "o" or not t[at - 1].isspace() or "�" in m[0]):
                t, marks = t[:at].rstrip(), marks + name
    return t, marks


def _kind(line: str, fenced: bool) -> str:
    s = line.strip()
    if fenced:
        return "code"
    if s.startswith("```"):
        return "fence"
    if s.startswith("#"):
        return "head"
    if s.startswith("|"):
        return "table"
    if LIST.match(line):
        return "list"
    if DATE.match(s):
        return "log"
    if PAIR.fullmatch(s):
        return "pair"
    return "plain"


def _bucket(n: float) -> int:
    return min(9, int(np.log2(n + 1) * 1.5))


def describe(text: str) -> tuple[list[int], str, str]:
    """Hashed features of a text's end, and the forms of its last two tokens."""
    t, marks = _bare(text)
    head, _, line = t.rpartition("\n")
    fenced = (head.count("\n```") + head.startswith("```")) % 2 == 1
    kind = _kind(line, fenced)
    if kind == "code" and line.strip().startswith("```"):
        kind = "close"
    words = line.split()
    last = words[-1] if words else ""
    before = words[-2] if len(words) > 1 else ""
    tok, tok2 = token_form(last), token_form(before)
    ends = [m.end() for m in SENTENCE_END.finditer(line)]
    done = bool(ends) and ends[-1] == len(line)
    since = len(line[(ends[-1] if ends else 0) :].split())
    c = t[-1:]
    cls = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    shape = REPEATED.sub(r"\1", LOWER.sub("a", UPPER.sub("A", DIGIT.sub("0", last))))[-8:]
    prev = head.rpartition("\n")[2].strip()
    prev_kind = _kind(prev, fenced) if prev else "blank"
    flat = NUMBER.sub("0", line.strip().lower())
    f = [
        f"c={cls}", f"cc={kind},{cls},{done}", f"m={marks}", f"mk={marks},{done},{kind}", f"k={kind},{prev_kind}", f"done={done}",
        f"t={tok}", f"t2={tok2} {tok}", f"kt={kind},{tok}", f"sh={kind},{shape}", f"e3={t[-3:].lower()}", f"since={kind},{done},{min(since, 8)}",
        f"w={kind},{min(len(words), 10)}", f"p={' '.join(words[:2]).lower()},{min(len(words), 12)},{done}", f"len={_bucket(len(t))},{kind}", f"tl={kind},{min(len(tok), 12)}", f"mt={marks},{tok}",
        f"fl={' '.join(words[:2]).lower()}|{tok}|{min(len(words), 12)}",
        f"open={line.count('(') > line.count(')')},{line.count('`') % 2},{kind}", f"q={line.count(chr(34)) % 2},{kind}", f"fenced={fenced and kind != 'close'},{cls}",
        f"l={flat}", f"pl={ASCII_NUMBER.sub('0', prev.lower())}|{flat}",
    ]
    if kind == "table":
        f.append(f"tb={line.count('|') - prev.count('|')},{cls}")
    if m := HEXADECIMAL.search(last):
        f.append(f"hex={min(len(m[1]), 65)}")
    if "://" in last:
        f.append("url")
    return sorted({RESERVED + zlib.crc32(x.encode()) % (DIM - RESERVED) for x in f}), tok, tok2


def _inside(left: str, right: str) -> bool:
    """Whether the place between two parts of a text lies inside a word or sentence."""
    kept, rest = left.rstrip(), right.lstrip(" ")
    if len(left) < 8 or not kept or not rest or rest[0] in "\n\r.!?," or left[-1] in "\n\r" or kept[-1] in "|`":
        return False
    return not (SENTENCE_END.search(kept[-4:] + " ") and kept[-1] in ".!?\"')")


def cut_points(text: str, seed: int, n: int) -> list[str]:
    """The text cut at up to n places inside a word or sentence, some with signs of omission or damage."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    out = []
    for _ in range(n * 3):
        if len(out) == n or len(text) < 12:
            break
        at = int(rng.integers(8, len(text) - 1))
        left, right = text[:at], text[at:]
        kept = left.rstrip()
        if not _inside(left, right):
            continue
        u = rng.random()
        out.append(left if u < 0.62 else kept if u < 0.72 else kept + "…" if u < 0.82 else kept + "..." if u < 0.9 else left + "�" if u < 0.94 else left + "%C" if u < 0.97 else kept + " …")
    return out


def whole_prefix(text: str, seed: int) -> str | None:
    """The text up to the end of one of its inner lines, which is a finished entry; null if none is found."""
    ends = [m.start() for m in re.finditer(r"\n", text)]
    rng = np.random.default_rng((seed ^ 0x5BD1E995) & 0x7FFFFFFF)
    for _ in range(6 if ends else 0):
        at = ends[int(rng.integers(len(ends)))]
        left, after = text[:at].rstrip(), text[at + 1 :].split("\n", 1)[0]
        head, _, line = left.rpartition("\n")
        fenced = (head.count("\n```") + head.startswith("```")) % 2 == 1
        wrapped = after[:1].islower() and _kind(line, fenced) == "plain" and len(line.split()) > 8
        if line.strip() and not wrapped and _kind(line, fenced) not in ("code", "head", "fence") and not re.fullmatch(r"[|\s:-]+", line):
            return left
    return None


_FEATURED = "doc_id bigint, source string, label int, n int, hashed array<int>, tok string, tok2 string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]
    names = ["doc_id", "source", "label", "n", "hashed", "tok", "tok2"]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sources, texts = (b.column(i).to_pylist() for i in range(3))
        yield _batch([(i, s, 0, len(t), *describe(t)) for i, s, t in zip(ids, sources, texts)])


def _cutter(times: int, piles: list[tuple[str, int]]):
    """Makes 2 * times cuts and up to times whole prefixes of each text; n is their length.

    piles: (source, length) of texts whose length piles up. Every other cut is made at such a length where the text is
    long enough, and has that source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                seed = zlib.crc32(f"{i}".encode())
                rng = np.random.default_rng(seed ^ 0x2545F491)
                for k, x in enumerate(cut_points(t, seed, 2 * times)):
                    at = None
                    for _ in range(8 if piles and k % 2 else 0):
                        at = piles[int(rng.integers(len(piles)))]
                        if _inside(t[: at[1]], t[at[1] :]):
                            break
                        at = None
                    if at:
                        u = rng.random()
                        mark = "" if u < 0.7 else "…" if u < 0.85 else "..."
                        rows.append((i, at[0], 1, at[1], *describe(t[: at[1] - len(mark)] + mark)))
                    else:
                        rows.append((i, s, 1, len(x), *describe(x)))
                for k in range(times):
                    if x := whole_prefix(t, seed + k):
                        rows.append((i, s, 0, len(x), *describe(x)))
            yield _batch(rows)

    return run


def line_end_counts(docs: DataFrame) -> DataFrame:
    """``tok, tok2, n, e``: over all texts, how often a token follows another in a line, and how often it then ends a line
    that isn't the last one."""
    # Line ends are tokens of their own, so a text is taken apart once and not line by line.
    one_kind = F.replace(F.replace(F.trim("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    plain = F.regexp_replace(F.replace(F.lower(one_kind), F.lit("\n"), F.lit(" \n ")), r"[0-9]+", "0")
    ws = F.col("ws")
    places = F.arrays_zip(ws.alias("tok"), F.concat(F.array(F.lit("\n")), ws).alias("tok2"), F.slice(ws, 2, F.size(ws)).alias("next"))
    flat = docs.select(F.split(plain, r"[ \t\f\x0B]+").alias("ws")).select(F.explode(places).alias("p"))
    # The last token of a text has none after it.
    flat = flat.where("p.tok <> '\n' AND p.tok <> '' AND p.next IS NOT NULL")
    flat = flat.select("p.tok", F.when(F.col("p.tok2") == "\n", "").otherwise(F.col("p.tok2")).alias("tok2"), (F.col("p.next") == "\n").alias("ends"))
    # Counted as they are written, then once more by their form: a spelling is brought to its form once.
    raw = flat.groupBy("tok", "tok2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ends").cast("int")).alias("e"))
    form = lambda c: F.trim(c, F.lit(".,;:!?()[]\"'`*…")).alias(c)
    return raw.select(form("tok"), form("tok2"), "n", "e").groupBy("tok", "tok2").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def limits(docs: DataFrame) -> DataFrame:
    """``source, n, limit``: bucket of how far the number of texts of a length exceeds that of lengths nearby."""
    counts = docs.groupBy("source", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    near = counts.select("source", F.explode(F.array_remove(F.sequence(F.col("n") - 6, F.col("n") + 6), F.col("n"))).alias("n"), "c")
    around = near.groupBy("source", "n").agg((F.sum("c") / 12).alias("around"))
    ratio = F.col("c") / (F.coalesce("around", F.lit(0.0)) + 1)
    return counts.join(around, ["source", "n"], "left").select("source", "n", F.when(ratio >= 3, 5).when(ratio >= 2, 3).otherwise(0).alias("limit"))


def _share(base: int, n: Column, e: Column) -> Column:
    """Index of a count bucket and of how often it ends a line; index base is 'never seen'."""
    size = F.least(F.floor(F.log2(n.cast("double"))), F.lit(7)).cast("int")
    part = F.least(F.floor(e / n * 7.999), F.lit(7)).cast("int")
    return F.when(n.isNull() | (n == 0), F.lit(base)).otherwise(F.lit(base + 1) + size * 8 + part)


def _indexed(rows: DataFrame, one: DataFrame, two: DataFrame, lim: DataFrame) -> DataFrame:
    """Rows with the indices of their counts and of how far their length piles up in their source.

    Counts meet the distinct pairs of last tokens, not the rows, of which one pair or length may hold a large share.
    """
    pairs = rows.select("tok", "tok2").distinct().join(one, "tok", "left").join(two, ["tok", "tok2"], "left")
    pairs = written(pairs.select("tok", "tok2", _share(0, F.col("n1"), F.col("e1")).alias("i1"), _share(80, F.col("n2"), F.col("e2")).alias("i2")), "lookup")
    joined = looked_up(looked_up(rows, pairs, ["tok", "tok2"], "doc_id"), lim, ["source", "n"], "doc_id")
    own = F.array("i1", "i2", F.lit(160) + F.coalesce("limit", F.lit(0)))
    return joined.select("doc_id", "source", "label", "n", F.concat(own, "hashed").alias("features"))


def _piled() -> Column:
    return F.arrays_overlap("features", F.array(F.lit(163), F.lit(165)))


def _fit(rows: DataFrame, piled: dict[int, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression over sets of feature indices.

    piled: what share of the rows of each label is to have a length that piles up; without it lengths are left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    weight = F.lit(1.0)
    if piled is None:
        rows = rows.withColumn("features", F.filter("features", lambda x: ~x.between(160, 169)))
    else:
        counts = {(r.label, r.piled): r["count"] for r in rows.groupBy("label", _piled().alias("piled")).count().collect()}
        for (label, at), n in counts.items():
            if (label, not at) in counts:
                share = piled[label] if at else 1 - piled[label]
                weight = F.when((F.col("label") == label) & (_piled() == at), share * (n + counts[label, not at]) / n).otherwise(weight)
    # A sparse vector as it is stored, read back as one.
    places = F.array_sort(F.array_distinct("features"))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(DIM).alias("size"), places.alias("indices"), F.array_repeat(F.lit(1.0), F.size(places)).alias("values"))
    schema = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    stored = rows.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), vector.alias("features"))
    train = written(stored.coalesce(FIT_PARTS), "train", schema)
    model = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False, weightCol="weight").fit(train)
    return model.coefficients.toArray(), float(model.intercept)


def _scored(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            starts = lists.offsets.to_numpy()
            # The indices of a row are distinct, as those of counts lie apart and hashed ones were made a set; none has no index.
            z = np.add.reduceat(weights[lists.values.to_numpy()], starts[:-1]) + bias if len(lists) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-z))), b.column(2)], names=["doc_id", "source", "score", "piled"])

    return rows.select("doc_id", "source", _piled().alias("piled"), "features").mapInArrow(run, "doc_id bigint, source string, score double, piled boolean")


def truncation_scores(documents: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, source, score`` of every text: the chance that it was cut off.

    sample_rows bounds the rows of a fit, drawn by a hash of the text; half are cuts, the rest texts as they stand
    and texts that end with one of their inner lines.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", normal_source(F.col("source")).alias("source"), "text")
    two = written(line_end_counts(docs), "pairs")
    one = written(two.groupBy("tok").agg(F.sum("n").alias("n1"), F.sum("e").alias("e1")), "tokens")
    two = two.select("tok", "tok2", F.col("n").alias("n2"), F.col("e").alias("e2"))
    lim = written(limits(docs), "limits")
    whole = written(_indexed(written(docs.mapInArrow(_plain, _FEATURED), "described"), one, two, lim), "ends")
    n = whole.count()
    if not n:
        return whole.select("doc_id", "source", F.lit(0.0).alias("score"))
    share = min(1.0, sample_rows / 4 / n)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))
    picked = written(docs.where(draw), "picked")
    times = max(1, min(4, int(sample_rows / 4 / n)))

    def made(piles: list[tuple[str, int]]) -> DataFrame:
        return written(_indexed(written(picked.mapInArrow(_cutter(times, piles), _FEATURED), "made"), one, two, lim), "cuts")

    plain = whole.join(picked.select("doc_id"), "doc_id", "left_semi")
    first = written(_scored(whole, _fit(plain.unionByName(made([])))), "first")
    shares = {int(r.hit): r.share for r in first.groupBy((F.col("score") >= 0.5).alias("hit")).agg(F.avg(F.col("piled").cast("double")).alias("share")).collect()}
    piled = {k: min(0.99, max(0.01, shares.get(k, 0.0))) for k in (0, 1)}
    # At most a row per picked text: a length is there as often as cut texts have it.
    on = picked.join(first.where("piled AND score >= 0.5").select("doc_id"), "doc_id", "left_semi")
    piles = sorted((r.source, r.n) for r in on.select("source", F.length("text").alias("n")).collect())
    intact = first.where("score < 0.5").select("doc_id")
    keep = written(plain.join(intact, "doc_id", "left_semi"), "intact")
    return _scored(whole, _fit(keep.unionByName(made(piles).join(intact, "doc_id", "left_semi")), piled)).drop("piled")


def truncated(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` of the texts that were cut off."""
    return scores.where(F.col("score") >= threshold).select("doc_id").distinct()


def truncation_rates(documents: DataFrame, cut_ids: DataFrame) -> DataFrame:
    """``source, n_docs, n_cut, share_cut`` per source over all rows."""
    hit = cut_ids.select("doc_id", F.lit(1).alias("hit"))
    every = documents.select("doc_id", normal_source(F.col("source")).alias("source")).join(hit, "doc_id", "left")
    out = every.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("hit").alias("n_cut"))
    return out.withColumn("share_cut", F.col("n_cut") / F.col("n_docs"))
