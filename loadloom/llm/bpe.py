"""Token counts and ids for files of public byte-pair tokenizers."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: Unicode White_Space without the space and the line feed.
OTHER_SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　"
#: The published pre-tokenisation pattern of byte-level BPE (fixed value), with the white-space class spelt out.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ODD_SPACE = regex.compile(f"[{OTHER_SPACE}]|  | \n|\n |\n\n|^ | $")
#: Entries a worker's cache may hold before it starts anew.
CACHE_ENTRIES = 1_000_000
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts tokens by heap-and-linked-list merging; no ids are looked up.

    ``count(text)`` is the number of initial symbols minus the number of merges, plus one for each special string.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.marks = tuple(special)
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token: pop the lowest-rank adjacent pair until none is left."""
        symbols = self.symbols
        left = [symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(left)
        if n < 2:
            return n
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((left[i], left[i + 1]))) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = heappop(heap)
            a = left[i]
            if a is None or (j := after[i]) >= n or ranks.get((a, left[j])) != rank:
                continue  # one side has been merged since
            left[i], left[j] = a + left[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((left[i], left[k]))) is not None:
                    heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := ranks.get((left[p], left[i]))) is not None:
                heappush(heap, (r, p))
            merges += 1
        return n - merges

    def of_pieces(self, text: str) -> int:
        cache, total = self.pieces, 0
        for piece in PIECES.findall(text):
            n = cache.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) < 64:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = n
            total += n
        return total

    def of_ordinary(self, text: str) -> int:
        """A single space between two characters that aren't space always starts a pre-token, so words can be cached."""
        if not text:
            return 0
        if ODD_SPACE.search(text):
            return self.of_pieces(text)
        words = text.split(" ")
        cache = self.chunks
        total = self.of_pieces(words[0])
        for word in words[1:]:
            n = cache.get(word)
            if n is None:
                n = self.of_pieces(" " + word)
                if len(word) < 40:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.marks):
            return self.of_ordinary(text)
        parts = self.special.split(text)
        return sum(map(self.of_ordinary, parts)) + len(parts) - 1


#: The published pre-tokenisation pattern of word-level BPE (fixed value): no pre-token spans white space.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(model: dict) -> bool:
    """Whether a text's ids are those of its words: lower-cased, white space dropped between them, each ended by a suffix."""
    normal, pre = model.get("normalizer") or {}, model.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
    first = (pre.get("pretokenizers") or [pre])[0]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return bool(model["model"].get("end_of_word_suffix")) and set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and split and first["pattern"].get("Regex") == WORD_PIECES


class IdEncoder:
    """Token ids as packed bytes through the ``tokenizers`` library, with words cached.

    Words are looked up for vocabularies whose pre-tokens never span white space (``by_words``); with any other, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.marks = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.by_words = by_words(model)
        if not self.by_words:
            return
        self.mark = {c: self.whole(c) for c in ",."}
        suffix = model["model"]["end_of_word_suffix"]
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.lib.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def core(word: str) -> str:
        """The word whose ids a variant shares: lower case, without one mark after a letter (a pre-token of its own)."""
        if not word.isascii():
            return word
        if word[-1:] in (",", ".") and word[-2:-1] in LETTERS:
            return word[:-1].lower()
        return word if word.islower() else word.lower()

    def learn(self, words: list[str]) -> None:
        """Encode many words as one text. A word of ASCII letters is one pre-token, so its ids end with the first one that ends a
        word; for the others a token belongs to the word in which its offset lies."""
        plain = [w for w in words if w.isascii() and w.isalpha()]
        if plain:
            found = np.asarray(self.lib.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            self.share(plain, found, np.concatenate([[0], np.flatnonzero(self.ends_word[found]) + 1]))
        if len(plain) < len(words):
            other = [w for w in words if not (w.isascii() and w.isalpha())]
            found = self.lib.encode(" ".join(other), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in other)])
            at = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found.offsets))
            self.share(other, np.asarray(found.ids, dtype=f"<u{self.width}"), np.searchsorted(at, starts, side="left"))

    def share(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        packed, cuts = ids.tobytes(), (cuts * self.width).tolist()
        self.cache.update((w, packed[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self.whole(t) for t in texts]
        cache = self.cache
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[""] = b""
        of = cache.get
        split = [None if any(m in t for m in self.marks) else t.replace("\n", " ").split(" ") for t in texts]
        parts = [None if words is None else list(map(of, words)) for words in split]
        gaps = [[i for i, p in enumerate(part) if p is None] if part and None in part else () for part in parts]
        missing = {words[i] for words, gap in zip(split, gaps, strict=True) for i in gap}
        cores = {w: self.core(w) for w in missing}
        unknown = [c for c in set(cores.values()) if c not in cache]
        for at in range(0, len(unknown), 4096):
            self.learn(unknown[at : at + 4096])
        for w, core in cores.items():
            if w is not core:
                cache[w] = cache[core] + (self.mark[w[-1]] if len(w) > len(core) else b"")
        for words, part, gap in zip(split, parts, gaps, strict=True):
            for i in gap:
                part[i] = cache[words[i]]
        return [self.whole(t) if part is None else b"".join(part) for t, part in zip(texts, parts, strict=True)]
