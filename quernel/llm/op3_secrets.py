"""Secret scans: base patterns, and the guess cost of values in a credential context.

The cost of guessing a value is the least sum, over all segmentations, of the
log10 guesses of its segments (a listed word, a date, a repeat, a keyboard walk,
or brute force), found by dynamic programming over its positions.  A value next
to a credential name whose cost reaches ``GUESSES`` is a secret (``PHRASE``, if
it is several words); a placeholder such as ``changeme2024`` costs little and is
not.

The words are those that guessers try first, and a ranked dictionary: a table
that is passed in, or the words of the corpus itself by how many texts use them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, parts, table, utf8

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A name that holds credentials, and the whole value given to it, both however long.  A name may go on, but not as
#: another word would (author, secretary, tokenizer).  What follows a name is the same for all words in it, so only
#: the first is tried, and the time stays linear.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?:passphrase|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?(?-i:(?![a-z])))[A-Za-z0-9_-]*+["']?[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*(?:"([^"\r\n]++)"|'([^'\r\n]++)'|`([^`\r\n]++)`|([^\s"'`,;<>]++))""",
    re.ASCII | re.IGNORECASE,
)
#: A value that is code: a call, an index, a variable or the beginning of one.
CODE = re.compile(r"[A-Za-z_][\w.:-]*(?:\(.*\)|\[.*\])+|[\w.:$-]*[({\[]|\$\w+|[$%]?\{.*\}|\$\(.*\)|%\(.*\)s", re.ASCII | re.DOTALL)
PAIRS = {")": "(", "]": "[", "}": "{"}
NAMES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")
#: log10 guesses from which a value counts as a secret, and one of several words.
GUESSES, PHRASE = 9.0, 14.0
#: Words of a ranked dictionary at most, and the texts that must use one.
DICTIONARY, USED = 20_000, 5
#: The longest unit of a repeat, and the cost of what stands between two words.
UNITS, BETWEEN = 64, 0.5
#: Words that guessers try first, most common first.
WORDS = (
    "password passw0rd pass admin root user guest test demo example sample dummy default changeme change secret token "
    "key login welcome letmein hello monkey dragon master shadow sunshine princess football baseball superman batman "
    "love iloveyou trustno abc qwerty access server database data local host production staging develop dev prod app "
    "api web mail email your my the this here value string placeholder insert replace enter none null true false "
    "undefined redacted hidden private public client service account system super power summer winter spring autumn "
    "monday friday sunday january december london paris berlin madrid freedom whatever computer internet google "
    "michael jordan jessica ashley charlie thomas robert andrew daniel hunter ranger buster soccer hockey killer "
    "george pepper ginger maggie cookie cheese coffee banana orange apple flower summer lovely angel tiger lion eagle"
).split()


class Ranks(dict):
    """log10 of the guesses of each word: those that guessers try first, then others by rank."""

    def __init__(self, others=()):
        super().__init__((w, math.log10(i + 2)) for i, w in enumerate(dict.fromkeys([*WORDS, *others])))
        self.longest = max(map(len, self))


RANK = Ranks()
TERM = re.compile(rb"[a-z\x80-\xff]{3,40}")
LEET = str.maketrans("4@310$5!7", "aaeiossit")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
BRUTE = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26))


def near(a: str, b: str) -> bool:
    """Whether two keys are neighbours."""
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def guess_cost(value: str, enough: float = math.inf, ranks: Ranks = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of the whole of ``value`` needs.

    Every segmentation passes a position or jumps over it, so the least cost
    among the position and the ends that lie beyond it is a lower bound; once
    that reaches ``enough``, the bound is returned.  A walk is at most as long
    as the keyboard has keys; longer ones are several.
    """
    s, low = value, value.lower()
    if len(low) != len(s):  # a letter whose lower case is longer
        low = s
    plain = low.translate(LEET)
    n = len(s)
    size = sum(k for r, k in BRUTE if r.search(s)) + 33 * bool(re.search(r"[^0-9A-Za-z]", s))
    char = math.log10(max(size, 10))
    join = math.log10(2)  # each further segment doubles the ways to combine
    same = [0] * (UNITS + 1)  # by unit: up to where characters equal the one a unit later
    run = 0  # the end of the alphabetic or numeric run
    best = [0.0] + [math.inf] * n
    far, check = 0, 16
    for i in range(n):
        if i == check:
            if (bound := min(best[i : far + 1])) >= enough:
                return bound
            check = i + max(16, far - i)
        here = best[i] + (join if i else 0)
        spans = [(i + 1, best[i] + (BETWEEN if s[i] in " _-." else char))]
        for j in range(i + 3, min(n, i + ranks.longest) + 1):
            if (w := ranks.get(low[i:j])) is not None:
                spans.append((j, here + w + (0.3 if s[i:j] != low[i:j] else 0)))
            elif (w := ranks.get(plain[i:j])) is not None:
                spans.append((j, here + w + 0.6))
        if m := DATE.match(s, i):
            spans.append((m.end(), here + (math.log10(365 * 100) if m.end() - i > 4 else 2.0)))
        for unit in range(1, min(UNITS, (n - i) // 2) + 1):
            if (end := same[unit]) <= i:
                end = i
                while end + unit < n and s[end] == s[end + unit]:
                    end += 1
                same[unit] = end
            times = 1 + (end - i) // unit
            if times * unit >= max(3, 2 * unit):
                spans.append((i + times * unit, here + unit * char + math.log10(times)))
        j, turns, last = i + 1, 0, None
        while j < n and j - i < len(PLACE) and near(low[j - 1], low[j]):
            step = (PLACE[low[j]][0] - PLACE[low[j - 1]][0], PLACE[low[j]][1] - PLACE[low[j - 1]][1])
            turns, last = turns + (step != last), step
            j += 1
            if j - i >= 3:
                spans.append((j, here + math.log10(len(PLACE) * (j - i)) + turns * math.log10(4)))
        if run <= i + 1 and i + 1 < n:
            run, step = i + 1, ord(s[i + 1]) - ord(s[i])
            while abs(step) == 1 and run < n and ord(s[run]) - ord(s[run - 1]) == step:
                run += 1
        if run - i >= 3:
            spans.append((run, here + math.log10(62 * 2 * (run - i))))
        for j, cost in spans:
            best[j] = min(best[j], cost)
            far = max(far, j)
    return best[n]


def valued(m: re.Match) -> tuple[int, int] | None:
    """Where the value of a match of ``CONTEXT`` is; none if it is code.  A bracket that closes more than the value is not part of it."""
    k = next(k for k in (1, 2, 3, 4) if m[k] is not None)
    a, b = m.span(k)
    if k < 4:
        return a, b
    v = m[4]
    while v and v[-1] in PAIRS and v.count(v[-1]) > v.count(PAIRS[v[-1]]):
        v = v[:-1]
    return None if not v or CODE.fullmatch(v) else (a, a + len(v))


def find(text: str, ranks: Ranks = RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in a text, in code points, by start, then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HEX_RUN in raw.translate(HEX_TABLE):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(x in low for x in NAMES):
        for m in CONTEXT.finditer(text):
            if at := valued(m):
                value = text[slice(*at)].strip()
                need = PHRASE if " " in value else GUESSES
                if guess_cost(value, need, ranks) >= need:
                    found.append((*at, "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


HEX_TABLE = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
HEX_RUN = b"x" * 32


def dictionary(documents: DataFrame, text: str = "text", used: int = USED) -> DataFrame:
    """(word, n): the words of the corpus and how many texts use each, those of at least ``used`` texts.

    Copies of a text that meet in a task count once.  Each task sums its own
    words before the shuffle, and holds a bounded number of them.
    """

    def run(batches):
        total, seen = Counter(), set()
        for batch in parts(batches):
            for raw in utf8(batch.column(0)):
                if (h := hash(raw)) not in seen:
                    seen.add(h)
                    total.update(set(TERM.findall(raw.lower())))
            if len(total) > 200_000 or len(seen) > 200_000:
                yield made(total)
                total, seen = Counter(), set()
        yield made(total)

    def made(total):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    sums = map_arrow(documents.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= used).select(F.expr("try_validate_utf8(cast(word as string))").alias("word"), "n").where("word is not null")


def ranked(words: DataFrame | None, most: int = DICTIONARY) -> Ranks:
    """The ``most`` commonest words of a (word, n) table, after those that guessers try first."""
    if words is None:
        return RANK
    first = words.select("word", "n").where("word is not null and word <> ''").orderBy(F.desc("n"), "word").limit(most).toArrow()
    return Ranks(w.lower() for w in first.column("word").to_pylist())


def scan(documents: DataFrame, text: str = "text", key: str = "doc_id", words: DataFrame | None = None) -> DataFrame:
    """The key of each row and ``found``, an array of (start, end, kind) structs.

    ``words``: a dictionary of (word, n) rows, the larger n the earlier guessed.
    Null and empty texts have none; equal rows are each reported; whole texts are
    read, however long; other columns are not.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    sent = documents.sparkSession.sparkContext.broadcast(list(ranked(words)))

    def make():
        ranks = Ranks(sent.value)

        def work(batch: pa.RecordBatch) -> dict:
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in find(x, ranks)] if x else [] for x in batch.column(1).to_pylist()]
            return {key: batch.column(0), "found": pa.array(rows, kind)}

        return work

    return arrow_map(documents.select(key, text), make, f"{key} {dict(documents.dtypes)[key]}, found array<struct<start: long, end: long, kind: string>>")


def redact(documents: DataFrame, mask: str = "[SECRET]", text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """The rows with every secret of ``text`` replaced; a match with a value keeps the name before it."""
    sent = documents.sparkSession.sparkContext.broadcast(list(ranked(words)))

    def clean(x: str, ranks: Ranks) -> str:
        found = []
        for a, b, kind in find(x, ranks):
            if kind == "assign":
                a = ASSIGN.match(x, a).start(2)
            found.append((a, b))
        out, at = [], 0
        for a, b in sorted(found):
            if a >= at:
                out += [x[at:a], mask]
            at = max(at, b)
        return "".join(out) + x[at:]

    at = documents.columns.index(text)

    def run(batches):
        ranks = Ranks(sent.value)
        for batch in batches:
            values = pa.array([clean(x, ranks) if x else x for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), values)

    return map_arrow(documents, run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of base secrets, and all spans, of each document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(documents, words=dictionary(documents))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')".format
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.sha2(F.expr(joined("filter(found, x -> x.kind <> 'guess')")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(joined("found")).alias("spans"))
