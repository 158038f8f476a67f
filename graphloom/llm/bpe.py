"""Exact BPE encoding by backtracking, and decoding through an offset table.

Greedy left-to-right matching is not BPE, but a token sequence is the BPE result exactly when each adjacent pair is:
the encoder takes the longest token that starts at a position (all of them come from one Aho-Corasick pass), keeps it if
it may follow its predecessor, else tries the next shorter prefix, and steps back over positions proved dead. Whether two
tokens may stand side by side is found by undoing their merges along the seam, and is remembered in a table. Every
position is left at most once, so a word takes linear time, also one of a hundred thousand letters.

The vocabulary has word ends: the last byte of a word is another symbol than the same byte inside it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_rows, text_of

WORD_END = "</w>"
#: First code point after the blocks whose lower-case letters stay inside them.
LATIN_END = 0x180


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + n)] = b
    return table


class BacktrackingEncoder:
    """Words (bytes) to tokens. Tokens are numbered by merge order: single symbols first, then one number a merge."""

    def __init__(self, vocab: dict[str, int], merges: list, pair_limit: int = 300_000):
        import ahocorasick

        alphabet = _byte_alphabet()

        def symbols(token: str) -> str:
            ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
            body = [alphabet[c] for c in (token.removesuffix(WORD_END) if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        merged = {a + b for a, b in merges}
        order: dict[str, int] = {}
        for token in sorted((t for t in vocab if t not in merged), key=vocab.__getitem__):
            order[token] = len(order)
        self.split: list[tuple[int, int]] = [(n, n) for n in range(len(order))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = order[a], order[b]
            if (left, right) in self.pairs or a + b in order:
                raise ValueError(f"two merges make {a + b!r}: merge order does not number the tokens")
            self.pairs[left, right] = order[a + b] = len(self.split)
            self.split.append((left, right))
        self.ids = np.empty(len(order), "<u4")
        self.by_text: dict[str, int] = {}
        for token, n in order.items():
            self.ids[n] = vocab[token]
            self.by_text[symbols(token)] = n
        self.length = [0] * len(order)
        self.shorter = [-1] * len(order)
        self.automaton = ahocorasick.Automaton()
        # the automaton scans a node's edges in the order of insertion: early merges, so frequent letters, come first
        for text, n in sorted(self.by_text.items(), key=lambda item: (len(item[0]) == 1, item[1])):
            self.automaton.add_word(text, (n, len(text)))
            self.length[n] = len(text)
            for cut in range(len(text) - 1, 0, -1):
                if (found := self.by_text.get(text[:cut])) is not None:
                    self.shorter[n] = found
                    break
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pair_limit = pair_limit

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= self.pair_limit:
            self.fits.clear()
        self.fits[key] = answer = self._compatible(left, right)
        return answer

    def _compatible(self, left: int, right: int) -> bool:
        before = len(self.split)  # merges across the seam count if they come before this one
        while True:
            if self.pairs.get((left, right), before) < before:
                return False
            if left > right:
                before, inner = left, self.split[left][1]
                if inner != left:
                    left = inner
                    continue
                before, inner = right + 1, self.split[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                before, inner = right + 1, self.split[right][0]
                if inner != right:
                    right = inner
                    continue
                before, inner = left, self.split[left][1]
                if inner == left:
                    return True
                left = inner

    def encode(self, word: bytes) -> list[int]:
        """Numbers (by merge order) of the tokens of one word."""
        if not word:
            return []
        text = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        if (whole := self.by_text.get(text)) is not None:
            return [whole]
        longest: list[int] = [-1] * len(text)
        reach = [0] * len(text)
        for end, (n, size) in self.automaton.iter(text):
            if size > reach[start := end - size + 1]:
                reach[start], longest[start] = size, n
        dead = bytearray(len(text) + 1)
        tokens: list[int] = []
        length, shorter, known = self.length, self.shorter, self.fits.get
        at, token, size = 0, longest[0], len(text)
        while at < size:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if not tokens:
                        break
                    last = tokens[-1]
                    if (fits := known(last << 32 | token)) is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                if not tokens:
                    raise ValueError("a symbol is not in the vocabulary")
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
        return tokens


class _Remembered(dict):
    """Results by key: the last ``most`` / 2 and, until these are full again, those before them."""

    def __init__(self, function, most: int):
        self.function, self.most, self.old = function, most // 2, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 200:
            self[key] = value
        return value


class Tokenizer:
    """What the ``tokenizers`` library does for a word-end BPE file: special strings are cut out first, the rest is
    composed (NFC), lower-cased a character at a time, split by the file's pattern and encoded word by word.

    No word crosses white space, so encoded pieces between ASCII white space are remembered, up to ``cache_size`` of them
    and as many words, the oldest half forgotten at a time. Pieces with letters beyond the Latin blocks are normalised and split
    (not encoded) by the library, whose Unicode tables may be of another version than Python's.
    """

    def __init__(self, spec: str | bytes, cache_size: int = 500_000):
        import regex

        told = json.loads(spec)
        model = told["model"]
        if model.get("end_of_word_suffix") != WORD_END or model["type"] != "BPE":
            raise ValueError("a BPE vocabulary with word ends is expected")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.encoder = BacktrackingEncoder(model["vocab"], merges)
        self.id_bytes = [int(n).to_bytes(4, "little") for n in self.encoder.ids]
        self.spec = spec.decode() if isinstance(spec, bytes) else spec
        self.library = None
        self.alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens") or []):
            raise ValueError("added tokens that take white space or need normalising are not supported")
        contents = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None
        self.marks = sorted({c[:2].encode() for c in contents})
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        for name in (r"\p{L}", r"\p{N}", r"\s"):  # spelt out for the Latin blocks: the plain engine is faster
            is_one = regex.compile(name).fullmatch
            pattern = pattern.replace(name, "".join(f"\\u{c:04x}" for c in range(LATIN_END) if is_one(chr(c))))
        self.words = re.compile(pattern).findall
        self.foreign = re.compile(f"[^\\x00-\\u{LATIN_END - 1:04x}]").search
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pieces = [tokens[i].encode() + b" " if i in tokens else b"" for i in range(max(tokens) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.cached_words = _Remembered(self._encode_word, cache_size)
        self.cached = _Remembered(self._encode_piece, cache_size)

    def _encode_word(self, word: bytes) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.encoder.encode(word)))

    def _split(self, text: str) -> list[bytes]:
        if self.foreign(text):
            if self.library is None:
                from tokenizers import Tokenizer as Library

                self.library = Library.from_str(self.spec)
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.alphabet.__getitem__, word)) for word, _ in shown]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [word.encode() for word in self.words(text.lower())]

    def _encode_piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.cut is None or not any(mark in piece for mark in self.marks):
            return b"".join(map(self.cached_words.__getitem__, self._split(text)))
        return b"".join(
            self.special[part].to_bytes(4, "little")
            if part in self.special
            else b"".join(map(self.cached_words.__getitem__, self._split(part)))
            for part in self.cut.split(text)
            if part
        )

    def encode(self, text: str | bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cached.__getitem__, (text.encode() if isinstance(text, str) else text).split()))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings, a space between any two, in UTF-8: slices of one buffer found through the offset table."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(numbers):
            return b""
        start = self.offsets[numbers]
        size = self.offsets[numbers + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size)
        at += np.arange(ends[-1])
        return self.buffer[at].tobytes()[:-1]


_built: dict[str, Tokenizer] = {}


def tokenizer_for(spec: bytes) -> Tokenizer:
    """One tokenizer a Python worker and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Tokenizer(spec)
    return _built[key]


def encode_documents(documents: DataFrame, vocabulary: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode and decode the whole ``text`` of every row; no shuffle, one Arrow batch in memory at a time.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content (of a fixed size) is broadcast.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds token_ids (array of int), ``with_text`` adds
    decoded. A null text counts as empty (no tokens, hashes of nothing); a null doc_id stays null; repeated rows stay
    repeated; columns other than doc_id and text are ignored.
    """
    with open(vocabulary, "rb") as f:
        spec = documents.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(spec.value)
        for batch in batches:
            sizes, ids_hash, text_hash, kept_ids, kept_text = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = tokenizer.encode(text)
                decoded = tokenizer.decode(ids)
                sizes.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    kept_ids.append(np.frombuffer(ids, "<i4"))
                if with_text:
                    kept_text.append(decoded.decode())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(sizes, pa.int64())}
            out |= {"ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_ids:
                out["token_ids"] = pa.array(kept_ids, pa.list_(pa.int32()))
            if with_text:
                out["decoded"] = pa.array(kept_text, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return map_rows(narrow, run, schema)
