"""Secret scans: three fixed patterns, and automata inferred from labelled credentials that score every other candidate and its parts.

One pass over whole texts, no shuffle. The automata are fitted on the driver from
a bounded set of labelled examples and sent to the executors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, islice, pairwise, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.automata import Scorer, fit, labelled
from webstrata.llm.common import steps

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)
#: Runs that may be or hold a credential of an unlisted format; those shorter than the shortest example of any format are none.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Where a run may be a name and a value, an address, or words; most characters of several segments that are read as one (a longer one by its stretches).
VALUE, SEGMENT, WORD, BREADTH = re.compile(r"="), re.compile(r"[=/]"), re.compile(r"[=/.+_-]"), 256
#: Examples of each credential format that the automata are fitted on; as many again set the threshold.
EXAMPLES = 300

Span = tuple[int, int, str]


@lru_cache(maxsize=2)
def default_scorer(examples: int = EXAMPLES) -> Scorer:
    return fit(labelled(examples, 1), labelled(examples, 2), parts=lambda text: [text[a:b] for a, b in {trimmed(text, 0, len(text)), *parts(text, 0, len(text))}])


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and non-overlapping per kind; too short ones are dropped after matching."""
    found: list[Span] = []
    if WORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def value_of(text: str, start: int, end: int, kind: str) -> str:
    """What a base span holds as a credential: of an assignment the value."""
    return ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


def trimmed(text: str, start: int, end: int, marks: str = ".=-") -> tuple[int, int]:
    """The bounds without marks at the ends."""
    while start < end and text[start] in marks:
        start += 1
    while start < end and text[end - 1] in marks:
        end -= 1
    return start, end


@lru_cache(maxsize=8)
def runs_of(shortest: int) -> re.Pattern:
    return re.compile(f"{RUN.pattern[:-1]}{{{shortest},}}")


def pieces(text: str, base: Sequence[Span], shortest: int) -> Iterator[tuple[int, int]]:
    """What of each candidate run lies beside the base spans."""
    sorted_base, k = sorted((a, b) for a, b, _ in base), 0
    for m in runs_of(shortest).finditer(text):
        at, end = m.span()
        while k < len(sorted_base) and sorted_base[k][0] < end:
            a, b = sorted_base[k]
            if b > at:
                if at < a:
                    yield at, a
                at = b
            k += 1
        if at < end:
            yield at, end


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run's values between "=", segments between "/" and words between all marks, and stretches of segments that may be base64; the longest first."""
    found = set()
    for marks in VALUE, SEGMENT, WORD:
        cuts = [start - 1, *(m.start() for m in marks.finditer(text, start, end)), end]
        found |= {trimmed(text, a + 1, b, ".=-/") for a, b in pairwise(cuts)}
        if marks is SEGMENT:
            # upper and lower case are as common as in base64, unlike in paths of words and numbers
            run = text[start:end]
            upper, lower, dots = ([0, *accumulate(map(f, run))] for f in (str.isupper, str.islower, ".".__eq__))
            for k, a in enumerate(cuts):
                x = a + 1 - start
                for b in takewhile(lambda b: b - a <= BREADTH, islice(cuts, k + 2, None)):
                    y = b - start
                    if y - x >= 20 and min(upper[y] - upper[x], lower[y] - lower[x]) * 5 >= y - x and dots[y] == dots[x]:
                        found.add((a + 1, b))
    return sorted(found, key=lambda p: (p[0] - p[1], p[0]))


def learned_spans(text: str, base: Sequence[Span], scorer: Scorer) -> list[tuple[Span, float]]:
    """Other candidates that the automata score as credentials, beside the base spans: a whole run, or else the longest of its parts."""
    out, shortest = [], scorer.shortest

    def taken(start: int, end: int) -> bool:
        if end - start < shortest:
            return False
        score, _ = scorer.score(text[start:end])
        if score >= scorer.least:
            out.append(((start, end, "learned"), score))
        return score >= scorer.least

    for run in pieces(text, base, shortest):
        whole = trimmed(text, *run)
        if whole[1] - whole[0] < shortest or taken(*whole):
            continue
        found = bytearray(run[1] - run[0])  # the longest come first, so what overlaps a found part has an end in it
        for a, b in parts(text, *run):
            if b - a < shortest:
                break
            x, y = a - run[0], b - run[0]
            if (a, b) != whole and not found[x] and not found[y - 1] and taken(a, b):
                found[x:y] = b"\x01" * (b - a)
    return sorted(out)


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: Sequence[Span], mask: str) -> str:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


OWN = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_learned")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("best_score", T.DoubleType()), T.StructField("redacted", T.StringType())]
)


def _scan(scorer: Scorer, mask: str | None, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text)
                more = learned_spans(text, base, scorer)
                spans = base + [s for s, _ in more]
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                scores = [scorer.score(value_of(text, *s))[0] for s in base] + [x for _, x in more]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), max(scores, default=None), redacted(text, spans, mask) if mask is not None and raw is not None else None))
            columns = dict(zip(OWN.names, zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in out], schema=out)

    return run


def secret_scan(docs: DataFrame, *, scorer: Scorer | None = None, mask: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Finds credentials in every whole text.

    Takes `doc_id` and `text`; other columns are ignored, but those in `carry` come along.
    Returns doc_id, carry, counts by kind, base_sha256, spans, best_score (null without candidates) and,
    with a mask, redacted: the text with every span masked.
    Defined for odd inputs: a null text is empty, has no spans, and stays null when redacted. Repeated rows are
    scanned one by one; doc_id may be null. An empty table gives an empty one.
    """
    if clash := set(OWN.names) & set(carry):
        raise ValueError(f"carried columns with the operator's own names: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select("doc_id", *(c for c in carry if c != "text"), F.col("text").cast("string").alias("text"))
    out = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *(f for f in OWN.fields if mask is not None or f.name != "redacted")])
    return docs.mapInArrow(_scan(scorer or default_scorer(), mask, to_arrow_schema(out)), out)
