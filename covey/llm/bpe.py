"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side in no vocabulary entry can never be merged, so a cut
between them changes nothing: the fragments on either side are encoded on their own and concatenated.
White space is the commonest forced boundary (no entry contains it), and inside a piece of the
pre-tokenizer every byte pair that no entry contains is another. Fragments repeat, so their codes are
kept in a cache of bounded size. Normalising, splitting and merging a fragment are done by the
tokenizers library itself; files of this kind have BPE with word ends and no decoder.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from covey.llm.common import documents, own, pieces, text_of

#: Words in the young half of a cache; the old half is as large.
YOUNG = 120_000
#: Texts of letters, digits and marks of ASCII and Latin-1 alone; normalising leaves these as they are but for case.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: the pattern of the files' pre-tokenizer, for lower-cased texts that PLAIN covers.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
PIECES = re.compile(SPLIT.replace("\\p{L}", _LETTERS).replace("\\p{N}", "0-9"))


class Codec:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) does, and decodes as decode(ids, skip_special_tokens=False) does."""

    def __init__(self, path: str, young: int = YOUNG):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        assert model["type"] == "BPE" and not model["byte_fallback"] and spec["decoder"] is None and spec["post_processor"] is None
        assert spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT
        whole = Tokenizer.from_file(path)
        self.normalise, self.pieces = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end)
        inner = [m for m in merges if not m[1].endswith(self.end)]
        self.inner = BPE(vocab=model["vocab"], merges=inner)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marked = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.token = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.joined = {pair for t in model["vocab"] for pair in pairwise(t.removesuffix(self.end))}
        self.bytes = {c: self.pieces(chr(c))[0][0] for c in range(0xC0, 0x100)}  # as the pre-tokenizer writes their bytes
        self.words, self.known = _Cache(self._word, young), _Cache(self._coded, young)

    def fragments(self, piece: str) -> list[str]:
        """A pre-tokenized piece, cut at every pair of symbols that no vocabulary entry contains."""
        if self.joined.issuperset(pairwise(piece)):
            return [piece]
        at = [0, *(k + 1 for k, pair in enumerate(pairwise(piece)) if pair not in self.joined), len(piece)]
        return [piece[a:b] for a, b in pairwise(at)]

    def _coded(self, piece: str) -> tuple[int, str, str]:
        cuts = self.fragments(piece)
        ids = [t.id for k, f in enumerate(cuts) for t in (self.last if k == len(cuts) - 1 else self.inner).tokenize(f)]
        return len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        if PLAIN.fullmatch(text):
            pieces = [p if p.isascii() else p.translate(self.bytes) for p in PIECES.findall(text.lower())]
        else:
            pieces = [p for p, _ in self.pieces(self.normalise(text))]
        return [self.known[p] for p in pieces]

    def _word(self, word: bytes) -> tuple[int, str, str]:
        """Length, ids and tokens of a text without white space, as strings."""
        text, found, at = word.decode(), [], 0
        for special in self.marked.finditer(text):  # special tokens are cut out before all else
            found += self._plain(text[at : special.start()])
            found.append((1, str(self.special[special[0]]), special[0]))
            at = special.end()
        found += self._plain(text[at:] if at else text)
        if len(found) == 1:
            return found[0]
        found = [c for c in found if c[0]]
        return sum([c[0] for c in found]), " ".join([c[1] for c in found]), " ".join([c[2] for c in found])

    def codes(self, text: bytes) -> list[tuple[int, str, str]]:
        """The codes of the words of a text that have any."""
        found = list(map(self.words.__getitem__, text.split()))
        return found if all([c[0] for c in found]) else [c for c in found if c[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.codes(text.encode()) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


class _Cache(dict):
    """Two generations: when the young one is full it becomes the old one, and words in use move over."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: bytes | str):
        code = self.old.get(word) or self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 100:
            self[word] = code
        return code


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in pieces(batches):
        counts, ids, texts = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            codes = codec.codes(text)
            counts.append(sum(c[0] for c in codes))
            ids.append(" ".join([c[1] for c in codes]))
            texts.append(" ".join([c[2] for c in codes]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string()) for xs in (ids, texts))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in pieces(batches):
        ids = [[int(i) for _, s, _ in codec.codes(t) for i in s.split(" ")] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in pieces(batches, "ids"):
        texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs.

    Nulls: a null text is empty, a null doc_id stays. Empty texts, and texts of white space: no ids. Very
    long texts: read whole; a worker holds one at a time. Repeated rows: encoded one by one (there are no
    ties). Empty table: empty result. Other columns are ignored, whatever their names.
    """
    return own(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(lambda b: _ids(b, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of encode()'s result; a null array gives a null text, an empty one an empty text."""
    return own(encoded, "doc_id", "ids").mapInArrow(lambda b: _decoded(b, path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text. Cases as encode() has them."""
    return own(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(lambda b: _encoded(b, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir), tokenizer_path())
