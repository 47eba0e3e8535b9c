"""Byte-pair encoding with a public vocabulary: merges by rank from a priority queue over a linked list of symbols."""

from __future__ import annotations

import base64
import heapq
import json
import os
from functools import lru_cache

import regex

#: Folder of the vocabulary files; also a parameter of every operator.
TOKENIZERS = os.environ.get("DARKSLIDE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the public pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    #: Words whose ids are remembered; beyond that the memory starts anew.
    HELD = 300_000

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], first: list[int], words: dict[int, bytes]) -> None:
        """merges: pair of ids -> (rank, id); first: id of each byte; words: bytes of each id."""
        self._merges, self._first, self._words = merges, first, words
        self._split = regex.compile(PATTERN)
        self._held: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        """From a tokenizers file (.json) or a rank file (.tiktoken) of a byte-level vocabulary."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            letters, vocab = _byte_letters(), model["vocab"]
            words = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
            merges = {}
            for rank, pair in enumerate(model["merges"]):
                a, b = pair.split(" ") if isinstance(pair, str) else pair
                merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
            return cls(merges, [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], words)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merges = {}
        for token, i in ranks.items():
            # Any two words that make up a word may merge, at its rank.
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    merges[ranks[token[:k]], ranks[token[k:]]] = (i, i)
        return cls(merges, [ranks[bytes([b])] for b in range(256)], {i: t for t, i in ranks.items()})

    def word(self, word: str) -> list[int]:
        """Ids of one piece of text that the pattern doesn't split."""
        ids = [self._first[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return ids
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self._merges
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = behind[i]
            # Stale, if either symbol has merged since.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            behind[i] = k = behind[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for null and empty texts."""
        if not text:
            return []
        held, out = self._held, []
        for piece in self._split.findall(text):
            found = held.get(piece)
            if found is None:
                found = self.word(piece)
                if len(held) >= self.HELD:
                    held.clear()
                if len(piece) < 64:
                    held[piece] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._words.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """Read once by each worker process from its own disk."""
    for end in ("json", "tiktoken"):
        if os.path.exists(path := os.path.join(folder, f"{name}.{end}")):
            return Encoder.load(path)
    raise FileNotFoundError(os.path.join(folder, name))
