"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of its encoding. Tokens that end at a
prefix come from an automaton with suffix links over the vocabulary, longest first; the right one is
the first whose pair with the last token of the prefix before it is compatible, which is decided by
walking the two merge trees along the boundary. Back-pointers from the end give the ids. The cost is
linear in the word's matches, with no queue of merges, and each new pair is decided once.

Texts are normalised and lower-cased by the vocabulary file's own rules, as the tokenizers library applies
them: Python's Unicode tables are newer and compose some sequences of marks differently.

Words, tables and pairs seen before are kept by each Python worker within fixed bounds.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Entries that a worker keeps of words and of pairs; a full table starts anew.
MAX_KEPT = 400_000
WORD_END = "</w>"
#: Stands for the end of a word in the automaton; no byte maps to it.
END = "\0"

FACTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable ones stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


@functools.cache
def newer_letters() -> tuple[frozenset[str], str]:
    """Letters and numbers that `regex` knows and the tokenizers library, whose tables are older, takes for neither.

    As a set and as the inside of a character class.
    """
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    letters = regex.findall(r"[\p{L}\p{N}]", every)
    split = Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(letters))
    unknown = sorted(set(letters) - {c for c, _ in split})

    runs: list[list[int]] = []
    for c in map(ord, unknown):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return frozenset(unknown), "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) or r"\uFFFF"


#: Letters from here on may compose, or lower-case, by rules that differ with the age of Unicode tables.
COMPOSING = re.compile("[\u0300-\U0010ffff]")


class WordBpe:
    """The encoder of a vocabulary file with word ends: its merges, split pattern and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        ids: dict[str, int] = told["model"]["vocab"]
        self.names = {i: t for t, i in ids.items()}
        self.decimals = {i: str(i) for i in self.names}
        pattern = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.differing, unknown = newer_letters()
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{unknown}]]")
        self.words_of_differing = regex.compile(pattern, regex.V1)
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names.update({i: t for t, i in added.items()})
        self.decimals.update({i: str(i) for i in added.values()})
        self.added = added
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}

        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of its merge
        for k, (a, b) in enumerate(told["model"]["merges"]):
            pair = ids[a], ids[b]
            self.rank[pair] = k
            self.halves.setdefault(ids[a + b], (*pair, k))
        self.left_edges: dict[int, tuple] = {}
        self.right_edges: dict[int, tuple] = {}
        whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in sorted(ids.items(), key=lambda x: x[1]):
            if i in added.values():
                continue
            halves = self.halves.get(i)
            whole[i] = halves is None or (whole[halves[0]] and whole[halves[1]] and self._meet(*halves))
            if whole[i]:
                text = name[: -len(WORD_END)] + END if name.endswith(WORD_END) else name
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.kept: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """The tokens on the boundary side of a token's merge tree, smallest first, and when each is merged away."""
        nodes, ends = [token], [float("inf")]
        while halves := self.halves.get(nodes[-1]):
            nodes.append(halves[side])
            ends.append(halves[2])
        return nodes[::-1], ends[::-1]

    def _meet(self, left: int, right: int, own: int | None = None) -> bool:
        """Whether no merge crosses the boundary between two tokens while each is being built.

        own: the rank of the merge of the two themselves, which is then no obstacle.
        """
        if (a := self.right_edges.get(left)) is None:
            a = self.right_edges[left] = self._edge(left, 1)
        if (b := self.left_edges.get(right)) is None:
            b = self.left_edges[right] = self._edge(right, 0)
        (a_nodes, a_ends), (b_nodes, b_ends), rank, x, y = a, b, self.rank, 0, 0
        while True:
            a_end, b_end = a_ends[x], b_ends[y]
            r = rank.get((a_nodes[x], b_nodes[y]))
            # Of equal ranks the leftmost pair merges first: the left token's own merge wins a tie, the right one's loses it.
            if r is not None and r < a_end and r <= b_end and r != own:
                return False
            if a_end <= b_end:
                if a_end == float("inf"):
                    return True
                x += 1
            else:
                y += 1

    def word(self, word: str) -> list[int]:
        """Ids of one word, as split by the pattern."""
        if not word.isascii() or not word.isprintable():
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        n, pairs = len(word), self.pairs
        last: list[tuple[int, int] | None] = [None] * (n + 2)
        for at, (token, length) in self.automaton.iter(word + END):
            at += 1
            if at == n or last[at] is not None:
                continue
            start = at - length
            if start:
                before = last[start]
                if before is None:
                    continue
                pair = before[0] << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MAX_KEPT:
                        pairs.clear()
                    fits = pairs[pair] = self._meet(before[0], token)
                if not fits:
                    continue
            last[at] = token, start
        ids, at = [], n + 1
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        words = self.words
        if COMPOSING.search(text) is None:  # composed already, so lower case is all there is to it
            text = text.lower()
        else:
            text = self.normalize(text)
            if not self.differing.isdisjoint(text):
                words = self.words_of_differing
        ids: list[int] = []
        kept = self.kept
        for word in words.findall(text):
            got = kept.get(word)
            if got is None:
                if len(kept) >= MAX_KEPT:
                    kept.clear()
                got = self.word(word)
                if len(word) < 64:
                    kept[word] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        if self.added_pattern is None or "<" not in text:
            return self.plain(text)
        ids, at = [], 0
        for m in self.added_pattern.finditer(text):
            ids += self.plain(text[at : m.start()])
            ids.append(self.added[m[0]])
            at = m.end()
        return ids + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, word ends shown, as this vocabulary's file asks for (it names no decoder)."""
        names = self.names
        return " ".join([names[i] for i in ids])


@functools.cache
def word_bpe(path: str | None = None) -> WordBpe:
    """The encoder of a vocabulary file, built once a worker."""
    import public_tokenizers

    return WordBpe(path or public_tokenizers.path("word_bpe_49k.json"))


def encode_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each input row; null and empty texts give an empty array.

    Ids may repeat or be null; extra columns are ignored; a text is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path).encode
        for batch in batches:
            ids = pa.array([encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = word_bpe(path).decode
        for batch in batches:
            texts = pa.array([decode(ids.as_py() or []) for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """FACTS of each row: its text encoded, and these ids decoded, both in the row's own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        decimals = bpe.decimals
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([decimals[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            told = [pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], [c.split()[0] for c in FACTS.split(", ")])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, FACTS)
