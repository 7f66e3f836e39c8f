"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..sources.ship import ship
from .common import text_or_empty

END = "Ā"  # stands for the end of a word; bytes are the characters below it
MARK = "</w>"
#: Entries of a Python worker's cache; a full one is kept as the older of two until the next is full.
CACHE = 250_000
NO_RANK = 1 << 30


def _byte_of_char() -> dict[int, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain, strict=True)) | {256 + k: b for k, b in enumerate(other)}


class WordBPE:
    """Encodes as a word-end BPE vocabulary's merges do, in time linear in the word.

    A token sequence is the result of the merges exactly if every token is
    reachable and every two neighbours are compatible, that is, no merge across
    their border would have come before the merges that closed it. So a word is
    covered from the left by the longest matches; where neighbours clash, the
    next shorter token is tried, and where none is left the encoder steps back.
    Places known to lead nowhere are not entered twice.
    """

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        back = _byte_of_char()

        def inner(token: str) -> str:
            stem, end = (token[: -len(MARK)], END) if token.endswith(MARK) else (token, "")
            return "".join(chr(back[ord(c)]) for c in stem) + end

        ids = {inner(t): k for t, k in model["vocab"].items()}
        self.ids = ids
        size = max(model["vocab"].values()) + 1
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([size, *(k + 1 for k in special.values())])
        self.length = [0] * size
        for t, k in ids.items():
            self.length[k] = len(t)
        self.pair: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (inner(x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pair.setdefault(left << 20 | right, rank)
            made.setdefault(whole, (rank, left, right))
        self.right_edge = [self._edge(k, made, 2) for k in range(size)]
        self.left_edge = [self._edge(k, made, 1) for k in range(size)]
        self.fits: dict[int, bool] = {}
        reachable = [
            t for t, k in ids.items()
            if k not in made or self._compatible(made[k][1], made[k][2], made[k][0])
        ]
        self.matcher = ahocorasick.Automaton()
        for t in reachable:
            self.matcher.add_word(t, ids[t])
        self.matcher.make_automaton()
        self.reachable = known = {t: ids[t] for t in reachable}
        self.shorter = [-1] * size
        for t in reachable:
            self.shorter[ids[t]] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        names = [""] * size
        for t, k in [*model["vocab"].items(), *special.items()]:
            names[k] = t
        raw = [(n + " ").encode() for n in names]
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.sizes = np.diff(self.offsets)
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.special = {t: k.to_bytes(4, "little") for t, k in special.items()}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        """The token and its parts along one edge, each with the rank of the
        merge that takes it up."""
        out, up = [], NO_RANK
        while True:
            out.append((token, up))
            if token not in made:
                return out
            up, token = made[token][0], made[token][side]

    def _compatible(self, a: int, b: int, before: int = NO_RANK) -> bool:
        """No merge across the border of a and b comes before ``before``, before
        the merge that takes up its left part, or with or before that of its
        right part (of equal merges the left one is first)."""
        for x, up_x in self.right_edge[a]:
            for y, up_y in self.left_edge[b]:
                rank = self.pair.get(x << 20 | y)
                if rank is not None and rank < before and rank < up_x and rank <= up_y:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        w = word.encode("utf-8", "replace").decode("latin-1") + END
        whole = self.reachable.get(w)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(w), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, k in self.matcher.iter(w):
            longest[end - length[k] + 1] = k
        dead = bytearray(n + 1)
        dead[n - 1] = 1
        out: list[int] = []
        at, k, last = 0, longest[0], -1
        while True:
            while k >= 0:
                if not dead[at + length[k]]:
                    if last < 0:
                        break
                    fit = fits.get(key := last << 20 | k)
                    if fit is None:
                        if len(fits) >= 2 * CACHE:
                            fits.clear()
                        fit = fits[key] = self._compatible(last, k)
                    if fit:
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at += length[k]
                if at == n:
                    return out
                k, last = longest[at], k
            else:
                dead[at] = 1
                k = out.pop()
                last = out[-1] if out else -1
                at -= length[k]
                k = shorter[k]

    def _piece(self, piece: str, single: bool) -> bytes:
        """Ids of a chunk without white space, or of a single pre-token, which
        is a chunk that parts into itself."""
        found = self.older.get(piece)
        if found is None:
            if single or piece.isalpha():
                found = np.array(self.encode_word(piece), "<u4").tobytes()
            else:
                found = b"".join([self.recent.get(w) or self._piece(w, True) for w in self.words.findall(piece)])
        if len(piece) < 100:
            if len(self.recent) >= CACHE:
                self.older = self.recent
                self.recent = {}
            self.recent[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.splitter.split(text) if self.splitter and "<|" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            low = part.replace("Σ", "σ").lower()  # the sigma rule at word ends isn't applied
            get = self.recent.get
            # only white space that Python and the pattern agree on may part chunks
            chunks = low.split() if not _ODD.search(low) else [low]
            out += [get(c) or self._piece(c, False) for c in chunks]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings with a space between each two: every byte
        is gathered from the table at its token's offset."""
        k = np.frombuffer(ids, "<u4")
        if not len(k):
            return b""
        size = self.sizes[k]
        ends = np.cumsum(size)
        at = np.repeat(self.offsets[k] - ends + size, size) + np.arange(ends[-1])
        return self.table[at].tobytes()[:-1]


_ODD = regex.compile("[\x1c-\x1f]")


@lru_cache(4)
def load(path: str) -> WordBPE:
    """One encoder for each file and Python worker."""
    return WordBPE(path)


def bpe_roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) per row of ``docs``: token ids of the whole text as
    little-endian unsigned 32-bit binary, and the UTF-8 binary they decode to.

    ``path`` is the vocabulary file, to be found at the same place on every
    node. Null text counts as empty and gives no ids; other columns are
    ignored; no rows give no rows; repeated rows and ids are encoded each.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [model.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    ship(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("t"))
    return narrow.mapInArrow(run, "id long, ids binary, decoded binary")
