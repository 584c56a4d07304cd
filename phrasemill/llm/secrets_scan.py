"""Secret scans with multipart credential linking (operator 4).

Base kinds stand alone: `assign`, `access`, `hex`. Parts of a credential are weak by themselves: an access identifier
(any AKIA run), a bare secret of 40 base64 characters, an endpoint (a URL of any scheme or a host with port). An interval join within each
text links parts in one scope: at most `scope` characters apart, or at most BLOCK apart within one block of the text, that is without a blank
line between them, as in a configuration section or a key file. A weak part is reported only where a complementary one is in its scope: `key_id` with a secret, `key_secret` with an identifier, `endpoint` with an identifier or a secret.

Results: null and empty texts have no spans; spans are code points, end exclusive, of the whole match; repeated
matches are each reported; texts of any length are scanned whole, and the links need O(n log n) of their parts.
Only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}|\b(?:[a-z0-9-]{1,63}\.){1,9}[a-z]{2,24}:[0-9]{2,5}\b")
#: Spans are listed by start, then in this order.
KINDS = ("assign", "access", "hex", "key_id", "key_secret", "endpoint")
LEAST = {"assign": 8, "access": 16, "hex": 32}
SCOPE = 200
#: Characters that parts of one block are apart at most.
BLOCK = 2000
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of matches that pass alone; a match that is too short still uses up its characters."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def within(parts: list[tuple[int, int]], others: list[tuple[int, int]], scope: int, blanks: list[int] = ()) -> list[bool]:
    """For each part, whether the next one of the others, before or after it and without overlap, is in its scope. blanks: where blank lines begin, in order."""
    starts = sorted(s for s, _ in others)
    ends = sorted(e for _, e in others)

    def linked(gap_start: int, gap_end: int) -> bool:
        if gap_end - gap_start <= scope:
            return True
        k = bisect_left(blanks, gap_start)
        return gap_end - gap_start <= BLOCK and (k == len(blanks) or blanks[k] >= gap_end)

    def near(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        if i < len(starts) and linked(e, starts[i]):
            return True
        i = bisect_right(ends, s) - 1
        return i >= 0 and linked(ends[i], s)

    return [near(s, e) for s, e in parts]


def linked_spans(text: str, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak parts that a complementary part in scope supports."""
    keys = [m.span() for m in ACCESS.finditer(text)]
    secrets = [m.span() for m in SECRET.finditer(text) if re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]) and re.search(r"[0-9]", m[0])]
    if not keys and not secrets:
        return []
    ends = [m.span() for m in ENDPOINT.finditer(text)]
    blanks = [m.start() for m in BLANK.finditer(text)]
    out = [(*p, "key_id") for p, ok in zip(keys, within(keys, secrets, scope, blanks), strict=True) if ok]
    out += [(*p, "key_secret") for p, ok in zip(secrets, within(secrets, keys, scope, blanks), strict=True) if ok]
    out += [(*p, "endpoint") for p, ok in zip(ends, within(ends, keys + secrets, scope, blanks), strict=True) if ok]
    return out


def scan(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """All spans in order; a span that the base has is not listed again as key_id."""
    if not text:
        return []
    base = base_spans(text)
    taken = {(s, e) for s, e, k in base if k == "access"}
    spans = base + [x for x in linked_spans(text, scope) if (x[0], x[1]) not in taken]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): base and linked spans of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        def work(keys, texts):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, scope)] for t in texts]
            return pa.RecordBatch.from_arrays([keys, pa.array(spans, pa.list_(span))], ["_id", "spans"])

        return work

    out = map_texts(docs, id_col, text_col, f"_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>", make)
    return out.withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans become one. Other columns stay as they are; null stays null."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                spans, parts, at = scan(text, scope), [], 0
                for s, e, _ in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else text)
            columns = list(batch.columns)
            columns[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def joined(spans: F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """kind:start:end of the spans, comma-joined in their order."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
