"""BPE encoding and decoding by speculation and verification.

A word's tokens are first proposed by greedy longest match against the vocabulary. A proposal is
the merge rules' own result exactly when every adjacent pair of its tokens is *compatible*: when
merging the pair's joined characters by the rules gives that pair again. Compatibility depends on
two ids only, so it is looked up for all adjacent pairs of all words of a batch at once (sorted
array search) and worked out by the rules once per new pair. Only words with an incompatible pair
are merged exactly. Words repeat, so results are kept in a bounded table per Python worker.

The model file (tokenizers JSON of a byte-level BPE with word ends) is a parameter; its bytes are
sent to the tasks. The steps before the merges follow the file: NFC, white space to one blank,
lower case, splitting at added tokens and into words, bytes as printable characters.

Cases: a null text is empty, and an empty text has no ids and decodes to an empty string; texts of
any length are read whole; repeated rows and null doc_ids are ordinary rows; extra columns are
ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .common import table
from .kernel import slices

CACHED_WORDS = 120_000        # bound of a worker's word table (besides one slice's words); when full it becomes the older of two tables
CACHED_PAIRS = 500_000        # bound of the known pairs of tokens
SLICE_CHARS = 1 << 20
SLICE_BYTES = 1 << 22         # bytes of texts handled at once
LONG_WORD = 100               # symbols from which a word is merged by a heap
# The file's word pattern, and the same pattern spelled out for text up to U+024F.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS, _BLANKS = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
LATIN_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+"


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


class Bpe:
    """Encoder and decoder for one model file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.none = len(merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for text, i in [*self.ids.items(), *self.added.items()]:
            self.strings[i] = text
        self.longest = max(map(len, self.ids))
        self.byte_chars = printable_bytes()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.by_file = regex.compile(pattern).findall
        self.latin = re.compile(LATIN_WORDS).findall if pattern == FILE_PATTERN else self.by_file
        self.data, self.library = data, None
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.table: dict[str, bytes] = {}                # word -> ids as bytes
        self.older: dict[str, bytes] = {}                # the table before it; words found there move up
        self.pairs = np.zeros(0, np.int64)               # known pairs, sorted, and their verdicts
        self.fits = np.zeros(0, bool)

    # --- before the merges -------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # no special case for a final sigma

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised. A text with characters newer than the standard
        library's Unicode tables is normalised and cut by the file's own library instead."""
        if text.isascii():
            return self.latin(text.lower())
        if max(text) <= "\u017f":
            return self.latin(self.normalise(text))
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._library_words(text)
        return self.by_file(self.normalise(text))

    def _library_words(self, text: str) -> list[str]:
        from tokenizers import Tokenizer
        if self.library is None:
            self.library = Tokenizer.from_str(self.data.decode())
            self.char_bytes = {c: b for b, c in enumerate(self.byte_chars)}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.char_bytes.__getitem__, w)).decode() for w, _ in cut]

    def symbols(self, word: str) -> list[str]:
        """A word's first symbols: one per byte, the last with the word end."""
        out = [self.byte_chars[b] for b in word.encode()]
        out[-1] += self.suffix
        return out

    # --- exact merging -----------------------------------------------------------------------
    def merge(self, parts: list[str]) -> list[str]:
        """Merge the leftmost pair of lowest rank until no rule applies (may change ``parts``)."""
        if len(parts) >= LONG_WORD:
            return self.merge_long(parts)
        rank, none = self.rank.get, self.none
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap of (rank, place) over linked symbols: a word of n symbols takes n log n steps."""
        n, rank, part = len(parts), self.rank.get, list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or rank((part[i], part[j])) != r:
                continue                                     # one of the two has been merged since
            part[i], part[j], after[i] = part[i] + part[j], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank((part[k], part[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in part if p is not None]

    def exact(self, word: str) -> list[int]:
        return [self.ids[p] for p in self.merge(self.symbols(word)) if p in self.ids]

    # --- speculation -------------------------------------------------------------------------
    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over the word's byte characters; None if something has no token."""
        chars = "".join(map(self.byte_chars.__getitem__, word.encode())) if not word.isascii() else word
        if word.isascii() and not word.isprintable():
            chars = "".join(map(self.byte_chars.__getitem__, word.encode()))
        whole, ids = chars + self.suffix, self.ids
        if whole in ids:
            return [ids[whole]]
        out, at, n, full = [], 0, len(chars), len(whole)
        while at < n:
            end = min(full, at + self.longest)
            while end > at:
                if (end <= n - 1 or end == full) and (i := ids.get(whole[at:end])) is not None:
                    break
                end -= 1
            else:
                return None
            out.append(i)
            at = end
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Verdicts for pairs of ids (left * 2^32 + right), new ones worked out by the rules."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        new = np.setdiff1d(pairs, self.pairs)
        if len(new):
            verdict = np.fromiter((self._fits(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in new), bool, len(new))
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, verdict)
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def _fits(self, left: int, right: int) -> bool:
        a, b = self.strings[left], self.strings[right]
        ended = b.endswith(self.suffix) and self.suffix != ""
        parts = list(a) + list(b[:len(b) - len(self.suffix)] if ended else b)
        if ended:
            parts[-1] += self.suffix
        return self.merge(parts) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Fill the table for words that it lacks: propose, verify all pairs, merge the rest."""
        proposed = [self.propose(w) for w in words]
        flat, owner = [], []
        for k, ids in enumerate(proposed):
            if ids is not None:
                flat.extend(ids)
                owner.extend([k] * len(ids))
        ids, owner = np.array(flat, np.int64), np.array(owner, np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        bad = np.zeros(len(words), bool)
        if len(inside):
            fit = self.compatible(ids[inside] << 32 | ids[inside + 1])
            bad[owner[inside[~fit]]] = True
        for k, w in enumerate(words):
            got = self.exact(w) if bad[k] or proposed[k] is None else proposed[k]
            self.table[w] = array("I", got).tobytes()

    # --- texts -------------------------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for a, b in _slices(texts):
            split = [self._split(t) for t in texts[a:b]]
            words = set().union(*(x for parts in split for x in parts if isinstance(x, list)))
            if len(self.table) > CACHED_WORDS:
                self.table, self.older = {}, self.table
            unknown = []
            for w in words:
                if w not in self.table:
                    if (known := self.older.get(w)) is not None:
                        self.table[w] = known
                    else:
                        unknown.append(w)
            self.learn(unknown)
            get = self.table.__getitem__
            for parts in split:
                out.append(b"".join(b"".join(map(get, x)) if isinstance(x, list) else x for x in parts))
        return out

    def _split(self, text: str) -> list:
        """Lists of words, and the ids of added tokens as bytes between them."""
        if not any(t in text for t in self.added):
            return [self.words(text)]
        return [np.array([self.added[x]], "<u4").tobytes() if x in self.added else self.words(x)
                for x in self.split_added(text) if x]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a blank between them, as the file without a decoder asks."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _by_bytes(batches, column: str):
    """The batches in slices of about ``SLICE_BYTES`` of texts, so that few are held as Python strings."""
    for b in batches:
        for a, n in slices(b.column(column), SLICE_BYTES):
            yield b.slice(a, n)


def _slices(texts: list[str]):
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n > SLICE_CHARS:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_LOADED: dict[str, Bpe] = {}


def _bpe(data: bytes) -> Bpe:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(data)
    return _LOADED[key]


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """docs -> ``keep`` columns, ids (little-endian unsigned 32-bit integers)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, docs[text].alias("_text"))

    def run(batches):
        bpe = _bpe(handle.value)
        for b in _by_bytes(batches, "_text"):
            ids = bpe.encode_batch([t or "" for t in b.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, "ids"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return src.mapInArrow(run, f"{kept}, ids binary")


def decode(coded: DataFrame, model: bytes, keep: tuple = ("doc_id",)) -> DataFrame:
    """coded(ids, ...) -> ``keep`` columns, decoded; null ids decode to an empty string."""
    handle = coded.sparkSession.sparkContext.broadcast(model)
    src = coded.select(*keep, coded["ids"].alias("_ids"))

    def run(batches):
        bpe = _bpe(handle.value)
        for b in batches:
            text = [bpe.decode(i or b"") for i in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], names=[*keep, "decoded"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_ids")
    return src.mapInArrow(run, f"{kept}, decoded string")


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of what ``encode`` gives, taken in the tasks."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        bpe = _bpe(handle.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in _by_bytes(batches, "text"):
            ids = bpe.encode_batch([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()),
                 pa.array((sha(bpe.decode(i).encode()) for i in ids), pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return digests(table(spark, sf_dir, "documents"), model_bytes())
