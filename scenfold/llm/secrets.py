"""Secret scans: known forms, and sliding-window entropy of candidate strings.

Known forms are assignments of a password-like name, access keys and long hexadecimal strings. Beside
them, every candidate (a run of 20 or more characters of keys and tokens) is searched per character
class: a window of ``WINDOW`` characters slides over each run of the class, its character
counts are kept up one character at a time, and windows with a Shannon entropy of the class's
threshold or more are merged to spans. Candidates that look like ordinary text are allowed: one letter case or
no digit, a path or address, a date or number, few distinct characters.

Scale: one Arrow pass over the texts, without a shuffle; a text of any length costs time in
proportion to it, and nothing is kept between texts.

Edge cases: a null text is empty and has no spans; spans count code points and end exclusively; equal
texts have equal spans; no rows give no rows; in redaction, other columns stay as they are, and
a null text stays null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The known forms, in the order of their kinds.
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
# Kind, a run of the class, and the least entropy in bits of a window.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.75),
)
# Letters of one case, capitalised or camel case words.
PLAIN = r"(?:[A-Z]+|[a-z]+(?:[A-Z][a-z]{2,})*|(?:[A-Z][a-z]{2,})+)"
# A date, and a time if there is one; what follows is judged by itself.
DATE = re.compile(
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-]?[0-9]{2}(?:-?[0-9]{2}){0,2}(?:Z|(?![0-9A-Za-z])))?[+/_=-]*"
)
ALLOWED = (
    re.compile(rf"[+/_=-]*{PLAIN}(?:[+/_=-]+{PLAIN})*[+/_=-]*"),  # words without a digit
    re.compile(r"[0-9+/_=-]*"),  # no letter
    re.compile(r"(.)\1*"),  # one character
    re.compile(rf"{PLAIN}(?:[/_=-]+(?:{PLAIN}|[0-9]{{1,4}}))+"),  # a path or a compound of words and short numbers
    re.compile(r"[A-Z]?[a-z]+[0-9]{1,4}"),  # a word with a number
)
TERMS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
REPLACEMENT = "[secret]"

Span = tuple[int, int, int]  # start, end, place of the kind


def known_forms(text: str) -> list[Span]:
    spans = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        spans += [
            (*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED
        ]
    spans += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    return spans


def high_windows(run: str, least: float) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of a run whose entropy is ``least`` bits or more.

    With counts c, the entropy is log2(w) - sum(c log2 c) / w; one character enters and one leaves.
    """
    most = (math.log2(WINDOW) - least) * WINDOW + 1e-9
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, entering in enumerate(run):
        c = counts.get(entering, 0)
        total += TERMS[c + 1] - TERMS[c] if c < WINDOW else 0.0
        counts[entering] = c + 1
        if i >= WINDOW - 1:
            if total <= most:
                if end < i - WINDOW + 1:
                    if end >= 0:
                        yield start, end
                    start = i - WINDOW + 1
                end = i + 1
            leaving = run[i - WINDOW + 1]
            c = counts[leaving]
            total += TERMS[c - 1] - TERMS[c]
            counts[leaving] = c - 1
    if end >= 0:
        yield start, end


def allowed(candidate: str) -> bool:
    if date := DATE.match(candidate):
        candidate = candidate[date.end() :]
        if len(candidate) < WINDOW:
            return True
    return any(p.fullmatch(candidate) for p in ALLOWED)


def entropy_spans(text: str) -> list[Span]:
    spans = []
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        if allowed(candidate):
            continue
        for kind, (_, run_of, least) in enumerate(CLASSES, start=3):
            for run in run_of.finditer(candidate):
                if allowed(run[0]):
                    continue
                at = m.start() + run.start()
                spans += [(at + a, at + b, kind) for a, b in high_windows(run[0], least)]
    return spans


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], s[2], s[1]))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in ordered)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch of overlapping spans replaced."""
    out, done = [], 0
    for a, b, _ in sorted(spans):
        if a >= done:
            out += [text[done:a], REPLACEMENT]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: the number of spans of each known form, those spans, and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = ([], [], []), [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                known = known_forms(text)
                for kind in range(3):
                    counts[kind].append(sum(s[2] == kind for s in known))
                base.append(joined(known))
                every.append(joined(known + entropy_spans(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(base, pa.string()), pa.array(every, pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string",
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``[secret]``; ``n_chars`` follows the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                if text is not None and (spans := known_forms(text) + entropy_spans(text)):
                    text = redacted(text, spans)
                texts.append(text)
            at = batch.schema.get_field_index("text")
            column = pa.array(texts, batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    )
