"""BPE encoding and decoding (operator 5).

Encoder: each pretoken is cut by an Aho-Corasick automaton into its longest token matches; a token may follow another
only if BPE would never have merged across their border, which a pair-compatibility table tells; where it may not, the
encoder goes back to the next shorter token. No position is tried twice, so the time is linear, and what comes out is
what the merges give. Decoder: one blob with the bytes of all tokens and a table of offsets into it.

Pretokens are kept in a bounded cache, as natural text repeats them; the cache is a speed-up only.

Defined results: a null or empty text has no tokens; special tokens inside a text are matched as the tokenizers library
matches them; texts of any length are encoded whole, document by document, without a shuffle.
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
from pyspark.sql import types as T

from quern.llm.common import arrow

#: Entries that a worker keeps, at most.
CACHE_ENTRIES = 600_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# The split pattern of byte-level BPE, for texts of which every character is in PLAIN.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _odd_pattern() -> re.Pattern:
    """Finds characters of which Python's classes may differ from the library's: those go through the library's own splitter."""
    known = [(9, 10), (13, 13), (32, 126), (160, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
    fine = [c for a, b in known for c in range(a, b + 1) if unicodedata.category(chr(c)) not in ("No", "Nl")]
    runs: list[list[int]] = []
    for c in fine:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


ODD = _odd_pattern()


class _Cache(dict):
    """Fills itself through ``make``; starts again when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.make(key)
        return value


class _Spaced(dict):
    """Packed ids of a blank and the word after it. A point or comma at a word's end is a pretoken of its own and isn't kept with it."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        c = self.codec
        if word.isalpha():
            value = c._piece(" " + word)
        elif word[-1:] in (".", ",") and word[:-1].isalpha():
            return self[word[:-1]] + c.piece[word[-1]]
        else:
            value = c._plain(" " + word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value
        return value


class Codec:
    """Encoder and decoder for a tokenizer file of the tokenizers library with byte-level BPE.

    ``by_library``: pretokens that aren't in the cache are merged by the library's own model instead of the backtracking encoder.
    """

    def __init__(self, path: str, by_library: bool = False):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocab = {"".join(chr(chars[c]) for c in k): v for k, v in model["vocab"].items() if all(c in chars for c in k)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens that reach beyond their own text are not supported")
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        latin = lambda s: "".join(chr(chars[c]) for c in s)
        # Order of tokens: single bytes first, then by the merge that makes them. 'rank' is that order, 'ids' goes back.
        made = [(latin(a), latin(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        base = [chr(b) for b in range(256)]
        order = {t: i for i, t in enumerate(base)}
        left, right = list(range(256)), list(range(256))
        self.by_library = by_library
        self.stand_in = {b: k for k, b in chars.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in made:
            r = order.setdefault(a + b, len(order))
            if r == len(left):
                left.append(order[a])
                right.append(order[b])
            self.pairs.setdefault((order[a], order[b]), r)
        self.left, self.right = left, right
        self.token = list(order)
        self.ids = np.array([vocab[t] for t in self.token], np.uint32)
        self.order = order
        self.auto = ahocorasick.Automaton()
        for t, r in order.items():
            self.auto.add_word(t, r)
        self.auto.make_automaton()
        self.shorter = _Cache(self._shorter)
        self.follows = _Cache(self._follows)
        # Decoding: the bytes of id i are blob[offsets[i] : offsets[i + 1]].
        by_id: dict[int, bytes] = {int(i): t.encode("latin-1") for i, t in zip(self.ids, self.token, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        self.offsets = np.concatenate([[0], np.cumsum([len(by_id.get(i, b"")) for i in range(size)])])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.piece = _Cache(self._piece)  # pretoken -> packed ids
        self.spaced = _Spaced(self)  # what stands between two blanks -> packed ids, blank included
        self.id_bytes = [int(i).to_bytes(4, "little") for i in self.ids]

    # The pair-compatibility table and the next shorter token, filled as they are needed.

    def _follows(self, pair: int) -> bool:
        """Whether BPE leaves these two tokens apart: undo merges at their border, latest first, and look for a pair that BPE would have merged before."""
        a, b = pair >> 20, pair & 0xFFFFF
        limit = len(self.token) + 1
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                if a < 256:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                limit, b = b + 1, self.left[b]

    def _shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of t, or -1."""
        s = self.token[t]
        for n in range(len(s) - 1, 0, -1):
            if (r := self.order.get(s[:n])) is not None:
                return r
        return -1

    def _longest(self, s: str, i: int) -> int:
        """The longest token that starts at i."""
        for _, r in self.auto.iter_long(s, i, min(len(s), i + 256)):
            return r
        raise AssertionError("every byte is a token")

    def backtrack(self, s: str) -> list[int]:
        """Ranks of the tokens of a pretoken, given as bytes in Latin-1."""
        follows, token = self.follows, self.token
        out = [r for _, r in self.auto.iter_long(s)]
        before = -1
        for t in out:
            if before >= 0 and not follows[before << 20 | t]:
                break
            before = t
        else:
            return out  # the longest matches all fit: going back isn't needed
        out = []
        dead = bytearray(len(s) + 1)
        i, t = 0, self._longest(s, 0)
        while True:
            end = i + len(token[t])
            if not dead[end] and (not out or follows[out[-1] << 20 | t]):
                out.append(t)
                i = end
                if i == len(s):
                    return out
                t = self._longest(s, i)
                continue
            t = self.shorter[t]
            while t < 0:  # nothing fits here: this position is dead, go back
                dead[i] = 1
                if not out:
                    raise AssertionError("no encoding")
                last = out.pop()
                i -= len(token[last])
                t = self.shorter[last]

    def _piece(self, word: str) -> bytes:
        if self.by_library:
            stand_in = word.translate(self.stand_in) if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.stand_in)
            return b"".join([x.id.to_bytes(4, "little") for x in self.library.model.tokenize(stand_in)])
        return b"".join(map(self.id_bytes.__getitem__, self.backtrack(word if word.isascii() else word.encode("utf-8").decode("latin-1"))))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, SPLIT.findall(text)))

    def _ordinary(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        if ODD.search(text):
            return b"".join(self.piece[text[a:b]] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or "\xa0" in text:
            return self._plain(text)
        # No blank has white space after it: a pretoken never reaches over the blank before a word.
        words = text.split(" ")
        return self._plain(words[0]) + b"".join(map(self.spaced.__getitem__, words[1:]))

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_re is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        out = []
        for k, part in enumerate(self.special_re.split(text)):
            if part:
                out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else self._ordinary(part))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, by_library: bool = False) -> Codec:
    """The worker's codec for this file."""
    if (path, by_library) not in _codecs:
        _codecs[path, by_library] = Codec(path, by_library)
    return _codecs[path, by_library]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as packed little-endian u32, decoded text) for each row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 64):  # a few documents at a time: memory holds these only
                ids = [c.packed(t) for t in texts[at : at + 64]]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)[at : at + 64], "ids": ids, "decoded": [c.decode(np.frombuffer(x, "<u4")) for x in ids]}, schema=arrow(ENCODED))

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ENCODED)


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what ``encode_documents`` gives, made in the same worker so that ids and texts need not leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        decimal = _decimals(c)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}, schema=arrow(DIGESTS))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGESTS)


def _decimals(c: Codec) -> list[str]:
    return [str(i) for i in range(len(c.offsets) - 1)]
