"""Secret scan: fixed patterns plus values whose guess cost is high.

The base patterns find assignments, access ids and long hex runs. The method adds spans: values in a
credential context (``passphrase: "..."``, ``pwd=...``, ``Bearer ...``) are cut into words, dates, repeats,
keyboard walks and brute-force spans so that the number of guesses is least, by dynamic programming over
the value. A value that takes at least ``min_cost`` (log10) guesses is reported as kind ``guess``; cheap
ones (placeholders, ``changeme``) are not.

Defined results: a null text counts as empty; a document without finds gives an empty list; a null id
stays null; repeated rows give repeated results; only the two named columns are read, so further columns
never clash. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
MIN_COST = 10.0

# The base patterns.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16

#: Credential contexts of the method; the value follows a separator, or white space after "bearer".
CONTEXT = re.compile(
    r"""(?i:(?<![a-z])(?:pass|auth)|pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|"""
    r"""private[_-]?key|credentials?)["']?[ \t]*(?::=|=>|->|[:=])[ \t]*|(?i:(?<![a-z])bearer[ \t]+)""",
    re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
VALUE = re.compile(r""""([^"\n]+)"|'([^'\n]+)'|["']?([^\s"'<>,;]+)""")

# Common words of passwords and placeholders, most frequent first.
WORDS = """password qwerty admin welcome letmein dragon monkey master login hello freedom whatever secret sunshine
princess football baseball shadow superman batman trustno iloveyou changeme default test guest root user pass
your here example token value string null none true false key api my the and you love summer winter spring autumn
monday friday january march april june july august october december london paris berlin madrid company office
server database system secure access account temp temporary sample dummy placeholder insert enter replace this
with new old big star magic king queen lucky angel happy flower butterfly cookie coffee chocolate banana orange
apple cheese pepper ginger tiger eagle falcon phoenix hunter ranger soldier killer ninja pirate robot matrix
starwars pokemon computer internet google mustang ferrari porsche harley yankees cowboys michael jordan daniel
thomas robert charlie jessica michelle ashley nicole hannah maggie buster correct horse battery staple""".split()
RANK = {w: n + 1 for n, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("013457@$!", "oleastasi")
# Rows of a keyboard, each row half a key right of the row above.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(
    r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
    r"(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|"
    r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d"
)
#: Years and days that a date or a year is guessed from.
YEARS, DAYS = 120, 366
#: Longest unit of a repeat, such as "abc" in "abcabc".
REPEAT_UNIT = 8
#: log10 cost of each cut between two segments.
CUT = math.log10(2)


def _neighbours() -> dict[str, set[str]]:
    place = {c: (r, x) for r, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    near = {}
    for a, (r, x) in place.items():
        near[a] = {
            b for b, (s, y) in place.items() if a != b and (s == r and abs(x - y) == 1 or abs(s - r) == 1 and y - x in (0, r - s))
        }
    return near


NEAR = _neighbours()
KEYS = len(NEAR)
TURNS = sum(map(len, NEAR.values())) / KEYS


def _alphabet(value: str) -> float:
    """Number of characters a brute-force guess of this value chooses from."""
    classes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in classes if any(map(test, value)))
    other = [c for c in value if not c.isalnum()]
    return size + 33 * any(c.isascii() for c in other) + 100 * (not value.isascii()) or 10


def _periods(value: str, unit: int) -> list[int]:
    """For each place, how many characters from it on equal the one ``unit`` places later."""
    same = [0] * (len(value) + 1)
    for i in range(len(value) - unit - 1, -1, -1):
        same[i] = same[i + 1] + 1 if value[i] == value[i + unit] else 0
    return same


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest cut of ``value`` into segments; 0 for an empty value.

    ``best[j]`` is the least cost of the first j characters, ``open_[j]`` the least whose last segment is a
    brute-force span; that span may go on without a further cut. Words are looked up to the longest word,
    repeats and walks run as far as they go, so the time is linear in the length.
    """
    n = len(value)
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != n:  # a few letters change their length
        low = plain = value
    step = math.log10(_alphabet(value))
    inf = float("inf")
    best, open_ = [inf] * (n + 1), [inf] * (n + 1)
    best[0] = 0.0

    def reach(i: int, j: int, cost: float) -> None:
        best[j] = min(best[j], best[i] + cost + (CUT if i else 0.0))

    period = [_periods(value, unit) for unit in range(1, REPEAT_UNIT + 1)]
    walked = 0
    for i in range(n):
        open_[i + 1] = min(open_[i], best[i] + (CUT if i else 0.0)) + step
        best[i + 1] = min(best[i + 1], open_[i + 1])
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            word = RANK.get(low[i:j])
            leet = 0.0 if word else CUT
            word = word or RANK.get(plain[i:j])
            if word:
                reach(i, j, math.log10(word + 1) + leet + (0.0 if value[i:j].islower() else CUT))
        if value[i].isdigit():
            for found in (DATE.match(value, i), DATE.match(value, i, i + 8), DATE.match(value, i, i + 4)):
                if found:
                    reach(i, found.end(), math.log10(YEARS * (DAYS if found.end() - i > 4 else 1)))
        if i >= walked and low[i] in NEAR:
            j = i + 1
            while j < n and low[j] in NEAR[low[j - 1]]:
                j += 1
            if j - i >= 3:
                for end in range(i + 3, j + 1):
                    reach(i, end, math.log10(KEYS) + (end - i - 1) * math.log10(TURNS) * 0.5)
            walked = j if j - i >= 3 else i
        for unit, same in enumerate(period, 1):
            if same[i] < unit or i and same[i - 1]:
                continue  # no repeat, or inside one that began earlier
            times = same[i] // unit + 1
            if times * unit >= 3:
                reach(i, i + times * unit, unit * step + math.log10(times))
    return best[n]


def base_spans(text: str, low: str) -> list[tuple[str, int, int, float | None]]:
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [("access", *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return spans + [("hex", *m.span(), None) for m in HEX.finditer(text)]


def guess_spans(text: str, low: str, min_cost: float) -> list[tuple[str, int, int, float | None]]:
    """Values of credential contexts that are hard to guess. A bare word of one letter case is prose."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    spans, at = [], 0
    while context := CONTEXT.search(text, at):
        at = context.end()
        found = VALUE.match(text, at)
        if not found:
            continue
        group = found.lastindex
        value = found[group]
        if group == 3 and value.isalpha() and (value.islower() or value[1:].islower() or value.isupper()):
            continue
        cost = guess_cost(value)
        if cost >= min_cost:
            spans.append(("guess", *found.span(group), cost))
            at = found.end(group)
    return spans


def find_spans(text: str | None, min_cost: float = MIN_COST) -> list[tuple[str, int, int, float | None]]:
    """All spans of one text as (kind, start, end, cost), by start and then kind; offsets are code points."""
    text = text or ""
    low = text.lower()
    spans = base_spans(text, low) + guess_spans(text, low, min_cost)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,cost:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """One row per document: ``doc_id`` and its spans. No shuffle; a task holds one Arrow batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in find_spans(t.as_py(), min_cost)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, from ``scan_secrets`` rows."""

    def written(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["cost"])).alias("hardest"),
    )
