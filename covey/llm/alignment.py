"""Alignment of two tokenizers: what one's tokens are in terms of the other's, text by text and corpus-wide.

A is a byte-level BPE (tokenizers library), B a sentencepiece model; both write a text, with a space before
it, as tokens whose bytes joined are that text. The cumulative ends of the two token lists are merged by
two pointers inside mapInPandas: every step is a link of two tokens that overlap, and where both end
together a group ends. Tokens of either kind never reach over a space that follows a non-space (the files
are checked for that), so a text is cut there, and the merge of a piece is kept for the next time.
Each text keeps its distinct links, with how often it has them. Spark counts the texts of each link,
joins the counts and the largest count of each A token back to the links, and adds them up.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import documents, own, staged, text_of

#: Pieces in the young half of a cache (the old half is as large), and code points of the longest that is kept.
YOUNG, KEPT = 250_000, 100
#: Rows, and links, that a worker returns at once.
ROWS, LINKS = 256, 1 << 18
#: Distinct links, at most, whose counts are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 20
#: Pieces of ASCII's visible characters and letters of Latin-1, and how A's pre-tokenizer splits them (fixed value: its pattern, for these and the space before them).
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+")
#: Stands for a line's end between words; no text can hold it.
LINE = "\ud800"
_MARKED = re.compile(f"([!-~{_LETTERS}]*[{_LETTERS}])([!-/:-@\\[-`{{-~]{{1,8}})")
#: White space other than single spaces and line ends between words; such texts are cut at spaces after a non-space alone.
_ODD = re.compile(r"\s\s|[^\S \n]|^\s")
_CUT = re.compile(r"(?<=\S)(?= )")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones of Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the merges of pieces seen of late."""

    def __init__(self, path_a: str, path_b: str, young: int = YOUNG):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("A is not a byte-level BPE of texts as they are")
        self.model = BPE(vocab=spec["model"]["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        byte = _byte_of()
        self.chars = {b: c for c, b in byte.items()}
        self.bytes_a = [bytes(byte.get(c, 0x3F) for c in self.a.id_to_token(k)) for k in range(self.a.get_vocab_size())]
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(self.n_b)]
        if any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:], strict=False)):
            raise ValueError("tokens of B reach over a space: texts can't be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.single = self.b.encode("a ")[len(self.b.encode("a")) :]  # a space alone
        self.text_a, self.text_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(self.n_b)))
        self.joined = {pair for p in pieces for pair in pairwise(p)}
        if any("\n" in p for p in pieces):
            raise ValueError("tokens of B reach over a line's end: texts can't be cut there")
        self.young, self.known, self.old, self.part, self.ends = young, {}, {}, {}, {}

    def merge(self, a: list[int], b: list[int]) -> tuple[list[int], list[str]]:
        """Links in order, each pair of ids as one number, and the groups as text: two pointers over the cumulative ends, which must be equal at the last."""
        if not a:
            return [], []
        size_a, size_b = [len(self.bytes_a[k]) for k in a], [len(self.bytes_b[k]) for k in b]
        links, groups, i, j, from_i, from_j, end_a, end_b = [], [], 0, 0, 0, 0, size_a[0], size_b[0]
        while True:
            links.append(a[i] * self.n_b + b[j])
            if end_a < end_b:
                i += 1
                end_a += size_a[i]
            elif end_b < end_a:
                j += 1
                end_b += size_b[j]
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join([self.text_a[k] for k in a[from_i:i]])}|{','.join([self.text_b[k] for k in b[from_j:j]])}")
                if i == len(a):
                    return links, groups
                from_i, from_j = i, j
                end_a += size_a[i]
                end_b += size_b[j]

    def _ids(self, words: list[str], before: str) -> list[list[int]]:
        """Tokens of A of the pieces, each with `before` before it; plain ones skip the library's splitting."""
        out, rest = [], []
        for k, w in enumerate(words):
            if PLAIN.fullmatch(w):
                ids = []
                for p in PIECES.findall(before + w):
                    if (known := self.part.get(p)) is None:
                        known = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.chars))]
                        if len(p) < 4 and len(self.part) < self.young:
                            self.part[p] = known
                    ids += known
                out.append(ids)
            else:
                rest.append(k)
                out.append([])
        for k, e in zip(rest, self.a.encode_batch([before + words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def words(self, text: str) -> list[str]:
        """The pieces of a text: those after a space without it, those after a line's end with LINE in its place."""
        if _ODD.search(text) is None:
            return text.replace("\n", " " + LINE).split(" ")
        return [p[1:] for p in _CUT.split(" " + text)]

    def _one(self, a: list[int], b: list[int], want: bytes) -> tuple | None:
        if not b"".join([self.bytes_a[k] for k in a]) == b"".join([self.bytes_b[k] for k in b]) == want:
            return None
        links, groups = self.merge(a, b)
        return len(a), len(b), len(groups), array("q", links).tobytes(), ";".join(groups)

    def _end(self, marks: str) -> tuple | None:
        """The merge of marks that end a word: B has never joined them to it, a line's end before them cuts them off as well."""
        if (known := self.ends.get(marks)) is None:
            known = self.ends[marks] = self._one(self._ids([marks], "")[0], self.b.encode("\n" + marks)[2:], marks.encode())
        return known

    def _learn(self, words: list[str]) -> dict[str, tuple | None]:
        """For each piece: tokens of A and of B, groups, links as bytes, and the groups as text; None if the bytes differ.

        The merge of a plain word with marks behind it is that of the word and that of the marks, if B joins no two such characters.
        """
        out, stems, lines = {}, {}, [w for w in words if w.startswith(LINE)]
        whole = dict.fromkeys(w for w in words if not w.startswith(LINE))
        for w in list(whole):
            if (m := _MARKED.fullmatch(w)) and (m[1][-1], m[2][0]) not in self.joined and len(w) <= KEPT:
                del whole[w]
                if (known := self.known.get(m[1], self.old.get(m[1]))) is None:
                    whole[m[1]] = None
                stems[w] = (m[1], m[2], known)
        for w, a, b in zip(whole, self._ids(list(whole), " "), self.b.encode(list(whole), num_threads=1), strict=True):
            out[w] = self._one(a, b if w else self.single, b" " + w.encode())
        for w in lines:
            own = "\n" + w[1:]
            out[w] = self._one(self._ids([own], "")[0], self.b.encode(own)[1:], own.encode())
        for w, (stem, marks, known) in stems.items():
            x, y = known or out[stem], self._end(marks)
            out[w] = x and y and (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], f"{x[4]};{y[4]}")
        return out

    def found(self, distinct: Counter) -> dict[str, tuple | None]:
        """The merges of these pieces."""
        known, old = self.known, self.old
        out = {w: known.get(w, known) for w in distinct}
        late = [w for w, x in out.items() if x is known]  # not there
        if late:
            out |= {w: old[w] for w in late if w in old} | self._learn([w for w in late if w not in old])
            fresh = {w: out[w] for w in late if len(w) <= KEPT}
            if len(known) + len(fresh) > self.young:
                self.old, self.known = known, {}
            self.known.update(fresh if len(fresh) <= self.young else {})
        return out

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A, of B, groups, SHA-256 of the groups ('' without tokens), distinct links as numbers, and how often each occurs."""
        none = (0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        if not text:
            return none
        words = self.words(text)
        counts = Counter(words)
        found = self.found(counts)
        if None in found.values():
            return none
        often, each = list(counts.values()), [found[w] for w in counts]
        sums = [sum(map(mul, often, [x[i] for x in each])) for i in range(3)]
        links = np.frombuffer(b"".join([x[3] for x in each]), np.int64)
        pairs, at = np.unique(links, return_inverse=True)
        times = np.bincount(at, weights=np.repeat(often, [len(x[3]) // 8 for x in each])).astype(np.int64)
        sha = hashlib.sha256()
        for k in range(0, len(words), 1 << 16):
            sha.update(((";" if k else "") + ";".join([found[w][4] for w in words[k : k + (1 << 16)]])).encode())
        return *sums, sha.hexdigest(), pairs, times


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _number(path_a: str, path_b: str) -> str:
    """The type of a link's number."""
    return "int" if len(_aligner(path_a, path_b).bytes_a) * _aligner(path_a, path_b).n_b < 1 << 31 else "long"


def _frames(frames: Iterator[pd.DataFrame], path_a: str, path_b: str) -> Iterator[pd.DataFrame]:
    aligner, names = _aligner(path_a, path_b), ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    rows, size = [], 0
    made = lambda: pd.DataFrame(rows, columns=names).assign(doc_id=lambda d: d.doc_id.astype("Int64"))
    for pdf in frames:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            rows.append((doc_id, *aligner.align(text)))
            size += len(rows[-1][-1])
            if len(rows) >= ROWS or size >= LINKS:
                yield made()
                rows, size = [], 0
    if rows:
        yield made()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row of docs its doc_id, n_a, n_b, n_groups, groups_sha256, and pairs and times: its distinct links (the id of A times the size of B, plus the id of B), and how often it has each.

    docs: doc_id and text. A text whose tokens, joined, are not the text with a space before it has none.
    """
    return docs.mapInPandas(lambda f: _frames(f, path_a, path_b), f"doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<{_number(path_a, path_b)}>, times array<int>")


def counted(pairs: DataFrame, n_b: int) -> DataFrame:
    """pair, count (rows that have it) and best (whether no other link of its A token has more), from rows of pair, one for each text that has it. Counts are summed before they are shuffled."""
    counts = staged(pairs.groupBy("pair").agg(F.count("*").alias("count")), "counts").withColumn("a", F.expr(f"pair div {n_b}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links: pairs of tokens whose bytes overlap. A link's count: the rows of docs that have a link of the
    same two ids. n_best: links whose count is the largest of their A token's, ties included; count_sum: the sum of the counts.
    Nulls and empty texts: zeros, and '' instead of the digest, and so where the tokens of A or B, joined,
    are not the text (a model may normalise); a null doc_id stays. Very long texts: aligned whole; a
    worker holds one at a time. Ties: every link with the largest count is one of the best. Repeated rows:
    each counts as a document. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_b = _aligner(path_a, path_b).n_b
    held = staged(aligned(rows, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = staged(counted(held.select(F.explode("pairs").alias("pair")), n_b), "links")
    size = counts.count()
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    links = held.select(*keys, F.posexplode("pairs").alias("at", "pair"), "times").select(*keys, "pair", F.col("times")[F.col("at")].alias("n"))
    met = links.join(F.broadcast(counts) if size <= broadcast else counts, "pair")
    sums = met.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n").cast("long") * F.col("count")).alias("count_sum"))
    none = held.where(F.size("pairs") == 0).select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")])
    return sums.unionByName(none).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def link_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The corpus's links: a, b (ids), count and best, as align() uses them. A table to translate one tokenizer's ids into the other's."""
    n_b = _aligner(path_a, path_b).n_b
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return counted(aligned(rows, path_a, path_b).select(F.explode("pairs").alias("pair")), n_b).select(F.expr(f"pair div {n_b}").cast("int").alias("a"), (F.col("pair") % n_b).cast("int").alias("b"), "count", "best")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark, sf_dir):
    return align(documents(spark, sf_dir), *tokenizer_paths())
