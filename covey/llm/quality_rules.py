"""Quality rules, line first: lines that fail are taken out, then documents that lose too much go.

Every line with a word is held against rules of its own (markup, shouting, navigation, boilerplate, end
punctuation). A document is rejected when the words of its failed lines are more than LOST of all its
words, or when it fails the base rules on the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from covey.llm.common import documents, numbered, own, pieces, place, text_of

#: Fixed by the contract: characters that count as symbols, words at least, share of repeated words at most, words of a window.
SYMBOLS, LEAST_WORDS, REPEATED, WINDOW = b"#*$%&|<>", 10, 20, 5
#: Line rules: symbols for each word, share of words that shout, separators of a menu, words of a line that may end as it likes, words of a line that may name boilerplate, share of a document's words that may go.
MARKUP, SHOUTING, SEPARATORS, FREE_END, PROSE, LOST = 0.25, 0.5, 3, 10, 25, 0.5
#: What speaks of cookies is boilerplate only beside words of consent or of a site.
CONSENT = r"accept|consent|polic(?:y|ies)|settings|preferences|browser|web ?site|(?:our|this) site|we use"
PHRASES = r"privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|licensed under|released under|copyright|subscribe to|sign up|log ?in to"
BOILERPLATE = re.compile(rf"\b(?:{PHRASES}|cookies?\b.*\b(?:{CONSENT})|(?:{CONSENT})\b.*\bcookies?)\b".encode(), re.IGNORECASE)
#: Ends of sentences in all scripts (Unicode's Sentence_Terminal), and what else may end a line; quotes and brackets may close behind them.
STOPS = "".join(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))) + "…:;؛"
CLOSED = r"[\"'\p{Pe}\p{Pf}]*$"
END = regex.compile(f"[{regex.escape(STOPS)}]{CLOSED}")
#: Scripts that write no stops (Thai, Lao): their lines may end as they like.
STOPLESS = "[\u0e01-\u0edf]"
_STOPLESS = re.compile(STOPLESS)
#: Words that separate the entries of a menu.
BETWEEN = frozenset(x.encode() for x in ("|", ">", "/", "-", "·", "»", "›"))


def failed_rule(line: bytes) -> str | None:
    """The first rule that a line with a word fails, or None."""
    words = line.split()
    n, between = len(words), sum(w in BETWEEN for w in words)
    if sum(line.count(bytes((c,))) for c in SYMBOLS) > MARKUP * n:
        return "navigation" if between >= SEPARATORS else "markup"
    if n >= 3 and sum(w.rstrip(b".").endswith((b"!!", b"??")) for w in words) > SHOUTING * n:
        return "punctuation"
    if between > max(SEPARATORS - 1, n // 4):
        return "navigation"
    if n < PROSE and BOILERPLATE.search(line):
        return "boilerplate"
    if n < FREE_END and n >= 2:
        text = line.rstrip().decode(errors="replace")
        if not END.search(text) and not _STOPLESS.search(text):
            return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur at least twice, the first occurrence included. Exact: windows are ranked, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    code = ids[:n]
    for k in range(1, window):
        if int(code.max() + 1) * len(index) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(index) + ids[k : n + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, bool, bool, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words of failed lines."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    seen: set[bytes] = set()
    dup = lost = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
            if failed_rule(line):
                lost += len(line.split())
    repeated = repeated_words(words)
    base = n < LEAST_WORDS or 100 * repeated > REPEATED * n
    return n, chars, sum(text.count(bytes((c,))) for c in SYMBOLS), dup, repeated, base, not base and lost <= LOST * n, lost


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"
_KINDS = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.int64(),)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [measures(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in found], k) for i, k in enumerate(_KINDS))], [c.split()[0] for c in _SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with the measures and the verdict.

    Nulls and empty texts: no words, and fail the base rules; a null doc_id stays. Very long texts: judged
    whole; a worker holds one at a time. Repeated rows: judged one by one (there are no ties). Empty
    table: empty result. Other columns are ignored, whatever their names.
    """
    return own(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(_rules, _SCHEMA)


def _kept(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, name):
        texts = batch.column(name).cast(pa.binary()).to_pylist()
        found = [measures(t) if t is not None else None for t in texts]
        kept = [m is not None and m[6] for m in found]
        at, field = batch.schema.get_field_index(name), batch.schema.field(name)
        left = [_cleaned(t) if m[7] else t for t, m, k in zip(texts, found, kept, strict=True) if k]
        yield batch.filter(pa.array(kept, pa.bool_())).set_column(at, field, pa.array(left, pa.binary()).cast(field.type))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names; the lines that fail are taken out of text.

    Null and empty texts go. For the other cases see quality_rules().
    """
    name = f"c{place(docs, 'text')}"
    rows = numbered(docs)
    return rows.mapInArrow(lambda b: _kept(b, name), rows.schema).toDF(*docs.columns)


def _cleaned(text: bytes) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not x.strip() or not failed_rule(x))


def cleaned_text(text: str) -> str:
    """A text without the lines that fail."""
    return _cleaned(text.encode()).decode()


def op6_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


_BETWEEN = ", ".join(f"'{x.decode()}'" for x in sorted(BETWEEN))
_END = (f"[{STOPS}]".replace("?", "\\?").replace(".", "\\.") + CLOSED).replace("'", "''")
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)),
m AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM l),
k AS (SELECT *, len(lw) AS n, len(list_filter(lw, lambda x: x IN ({_BETWEEN}))) AS between_words, len(regexp_extract_all(line, '[#*$%&|<>]')) AS marks, len(list_filter(lw, lambda x: regexp_matches(x, '(!!|\?\?)\.*$'))) AS shouts FROM m WHERE len(lw) > 0),
f AS (SELECT *, marks > {MARKUP} * n OR (n >= 3 AND shouts > {SHOUTING} * n) OR between_words > greatest({SEPARATORS} - 1, n // 4) OR (n < {PROSE} AND regexp_matches(line, '{BOILERPLATE.pattern.decode()}', 'i'))
  OR (n < {FREE_END} AND n >= 2 AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '{_END}') AND NOT regexp_matches(line, '{STOPLESS}')) AS failed FROM k),
g AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS dup, coalesce(sum(n) FILTER (WHERE failed), 0) AS lost FROM f GROUP BY 1),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 1))) AS i FROM d),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + {WINDOW} - 1]) > 1 AS again FROM x),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM y WHERE again) GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words FROM d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words) AND n_lost_words <= {LOST} * n_words AS kept, n_lost_words FROM b
"""
