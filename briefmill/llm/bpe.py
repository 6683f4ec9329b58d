"""BPE encoding and decoding (operator 10) by prefix-sharing trie traversal.

The distinct words of a batch go into a trie.  A depth-first walk carries, for every prefix, the last
token of that prefix's encoding: it is the one token ending there that may follow the last token of
what stands before it.  So a prefix shared by many words is encoded once, and each word's tokens are
read back along the path.  Whether two tokens may stand side by side is decided by undoing their
merges towards the border: some merge across it must not come earlier than the merges undone.

Nulls count as empty texts; an empty text has no tokens.  Rows are independent: repeated rows, ties
and row order do not matter, an empty table gives an empty table."""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from tokenizers import Tokenizer

from briefmill.llm.common import digest, map_arrow

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# The splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below these code points every Unicode version agrees on letters, numbers and white space.
# Texts with others are split by the tokenizer file's own splitter, which settles the version.
UNSETTLED = re.compile("[^\x00-՗‐-⁄]")
TOGETHER = 2_000_000  # characters whose distinct words share one trie
REMEMBERED = 80_000  # words in each of the two generations a task remembers; others are encoded again, results are the same


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, their merges in order, and the special tokens of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = spec["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        # order 0 for single bytes; a merge counts by its place in the list
        self.order = [0] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for place, pair in enumerate(spec["model"]["merges"], 1):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merged[a, b] = place
            if self.halves[c] is None:
                self.halves[c], self.order[c] = (a, b), place
        # for each token the longest shorter token that ends it, for each beginning of a token the longest that ends it
        self.shorter = {i: self._ending(token, 1) for token, i in self.ids.items()}
        self.ending = {begun: self._ending(begun, 0) for token in self.ids for begun in (token[: k + 1] for k in range(len(token)))}
        empty = spec | {"added_tokens": [], "model": spec["model"] | {"vocab": {}, "merges": []}}
        self.splitter = Tokenizer.from_str(json.dumps(empty)).pre_tokenizer
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _ending(self, text: bytes, begin: int) -> int:
        return next((self.ids[text[k:]] for k in range(begin, len(text)) if text[k:] in self.ids), -1)

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side.

        Going back through the merges of both, latest first, the pair at the border must never have
        a merge that would have come before the merge undone last."""
        later = len(self.merged) + 1
        while True:
            if self.merged.get((left, right), later) < later:
                return False
            a, b = self.order[left], self.order[right]
            if not a and not b:
                return True
            if a > b:
                later, left = a, self.halves[left][1]
            else:
                # equal merges apply from left to right: one across the border comes before the right token's
                later, right = b + 1, self.halves[right][0]


class WordEncoder:
    """Encodes sets of words by a walk over their trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[tuple[int, int], bool] = {}

    def _fits(self, left: int, right: int) -> bool:
        if len(self.known) > 2 * REMEMBERED:
            self.known.clear()
        found = self.known[left, right] = self.vocabulary.fits(left, right)
        return found

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        collecting = gc.isenabled()
        gc.disable()  # the many small trie nodes hold no cycles
        try:
            return self._walk(words)
        finally:
            if collecting:
                gc.enable()

    def _walk(self, words: list[bytes]) -> list[tuple[int, ...]]:
        root: dict = {}
        for number, word in enumerate(words):
            node = root
            for byte in word:
                child = node.get(byte)
                if child is None:
                    child = node[byte] = {}
                node = child
            node[-1] = number
        out: list[tuple[int, ...]] = [()] * len(words)
        tokens, shorter, ending = self.vocabulary.tokens, self.vocabulary.shorter, self.vocabulary.ending
        known, fits, single = self.known, self._fits, [bytes([b]) for b in range(256)]
        length = [len(x) for x in tokens]
        last: list[int] = []  # last[i]: the last token of the encoding of the path's first i + 1 bytes
        stack = [(0, b"", byte, child) for byte, child in root.items() if byte >= 0]
        while stack:
            depth, begun, byte, node = stack.pop()
            del last[depth:]
            begun += single[byte]  # the longest end of the path with which a token begins
            while begun not in ending:
                begun = begun[1:]
            token, depth = ending[begun], depth + 1
            while length[token] < depth:
                pair = last[depth - length[token] - 1], token
                fit = known.get(pair)
                if fits(*pair) if fit is None else fit:
                    break
                token = shorter[token]
            last.append(token)
            for b, child in node.items():
                if b >= 0:
                    stack.append((depth, begun, b, child))
                else:  # a word ends here
                    found, at = [], depth
                    while at:
                        found.append(last[at - 1])
                        at -= length[found[-1]]
                    found.reverse()
                    out[child] = tuple(found)
        return out


class TextEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = WordEncoder(vocabulary)
        self.pattern = regex.compile(PATTERN)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.vocabulary.splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in text order."""
        if self.vocabulary.specials is None or not self.vocabulary.specials.search(text):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.vocabulary.specials.split(text)):
            if k % 2:
                out.append("\0" + part)  # no word starts with this and goes on as a special token does
            elif part:
                out.extend(self.split(part))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start."""
        flat, offsets, waiting, size = array("i"), [0], [], 0
        for text in texts:
            waiting.append(self.pieces(text or ""))
            size += len(text or "")
            if size > TOGETHER:
                self._flush(waiting, flat, offsets)
                waiting, size = [], 0
        self._flush(waiting, flat, offsets)
        return np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32), np.array(offsets, np.int32)


    def _flush(self, texts: list[list[str]], flat: array, offsets: list[int]) -> None:
        memory, special = self.memory, self.vocabulary.special
        if len(memory) > REMEMBERED:
            self.older, self.memory = memory, {}
            memory = self.memory
        older, plain = self.older, []
        for word in {w for pieces in texts for w in pieces if w not in memory}:
            if word in older:
                memory[word] = older[word]
            elif word[0] == "\0" and word[1:] in special:
                memory[word] = (special[word[1:]],)
            else:
                plain.append(word)
        memory.update(zip(plain, self.words.encode([w.encode() for w in plain])))
        for pieces in texts:
            for word in pieces:
                flat.extend(memory[word])
            offsets.append(len(flat))


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shipped) -> Vocabulary:
    """One per Python worker and file."""
    key = hash(shipped.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shipped.value)
    return _LOADED[key]


def _ship(df: DataFrame, path: str):
    """The tokenizer file as a broadcast: a few megabytes, fixed for a given file."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _encoder(shipped) -> Callable[[pa.Array], pa.Array]:
    state: dict[str, TextEncoder] = {}

    def ids(texts: pa.Array) -> pa.Array:
        if not state:
            state["encoder"] = TextEncoder(_vocabulary(shipped))
        flat, offsets = state["encoder"].encode(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

    return ids


def _decoder(shipped) -> Callable[[pa.Array], pa.Array]:
    state: dict[str, tuple[np.ndarray, ...]] = {}

    def decoded(values: pa.Array) -> pa.Array:
        if not state:
            tokens = _vocabulary(shipped).tokens
            lengths = np.array([len(x) for x in tokens] + [0], np.int64)
            state["pool"] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths
        pool, starts, lengths = state["pool"]
        flat = np.asarray(values.flatten().fill_null(-1), np.int64)
        flat = np.where((flat >= 0) & (flat < len(starts) - 1), flat, len(starts) - 1)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(values), 0), np.int64)
        ends = np.cumsum(sizes)
        out = []
        for begin, end in zip(ends - sizes, ends):
            own = flat[begin:end]
            width = lengths[own]
            at = np.repeat(starts[own] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            out.append(pool[at].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return decoded


def encode(docs: DataFrame, path: str = TOKENIZER, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the token ids of the whole text; a column of that name is replaced."""
    run = _encoder(_ship(docs, path))

    @F.arrow_udf(t.ArrayType(t.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        return run(texts)

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str = TOKENIZER, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of the ids, special tokens included; bytes that form no character become
    U+FFFD.  Ids outside the vocabulary and nulls decode to nothing."""
    run = _decoder(_ship(docs, path))

    @F.arrow_udf(t.StringType())
    def decoded(values: pa.Array) -> pa.Array:
        return run(values)

    return docs.withColumn(out, decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per row: doc_id, ids and the text they decode to.

    Both steps in one pass: as two column functions on each other Spark would encode twice."""
    shipped = _ship(docs, path)

    def start():
        encoder, decoder = _encoder(shipped), _decoder(shipped)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder(batch.column("text"))
            return pa.record_batch([batch.column("doc_id"), ids, decoder(ids)], ["doc_id", "ids", "decoded"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, start, "doc_id bigint, ids array<int>, decoded string")


def tokenized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per row: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs, path).select(
        "doc_id", "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return tokenized(docs, path).drop("ids")
