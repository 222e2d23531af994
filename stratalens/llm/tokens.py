"""Token ids of whole texts by a public tokenizer, with a cache of the pieces between white space.

Where the tokenizer is a plain byte-level BPE whose merges stand in the order of their ids, texts of common letters and signs are
merged whole by tiktoken, from the ranks of the same vocabulary; it gives the same ids in less time. Other texts are cut into pieces,
those of common letters are merged in the same way, and everything else goes through the tokenizer itself.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache


#: Pieces in one generation of a worker's memory; the generation before is kept until the next is full.
REMEMBERED = 350_000
#: White space, if any, and the text up to the next white space. No pre-token of a byte-level BPE of this kind runs
#: from other text into white space, so the pieces can be encoded one by one. Python counts these four control
#: characters as white space and the tokenizer does not, so texts that have them are encoded whole.
PIECES = re.compile(r"\s*\S+|\s+")
UNSURE = re.compile(r"[\x1c-\x1f]")
#: Characters beyond these letters, dashes, quotes and signs may be letters or white space to one version of Unicode and not to another.
RARE = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122]")
#: How a byte-level BPE splits a text before it merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merger(tokenizer):
    """A function from a text to its ids that equals the tokenizer's, or None if its kind does not allow one."""
    import json

    import tiktoken

    told = json.loads(tokenizer.to_str())
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and told["post_processor"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if not plain or model["type"] != "BPE" or any(model.get(x) for x in odd):
        return None
    taken, known = {x["content"] for x in told["added_tokens"]}, byte_of()
    vocabulary = {word: i for word, i in model["vocab"].items() if word not in taken}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocabulary.get("".join(m), -1) for m in pairs]
    if ids != sorted(set(ids)) or min(ids, default=0) < 0 or len(ids) + 256 != len(vocabulary) or any(c not in known for word in vocabulary for c in word):
        return None
    ranks = {bytes(known[c] for c in word): i for word, i in vocabulary.items()}
    return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces(dict):
    """Ids by piece: what is found in the older generation moves to this one."""

    older: dict = {}  # never written to

    def __missing__(self, piece):
        ids = self[piece] = self.older[piece]
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), Pieces()
        self.merge = merger(self.tokenizer)
        #: Strings that the tokenizer takes out of a text before it splits it; texts that have one are encoded whole.
        self.taken = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _raw(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def encode_many(self, texts, at_once: int = 256):
        """The ids of each text; texts are taken some at a time, so that new pieces are found and encoded together."""
        for at in range(0, len(texts), at_once):
            part = [t or "" for t in texts[at : at + at_once]]
            whole = [any(x in t for x in self.taken) for t in part]
            plain = [bool(self.merge) and not w and not RARE.search(t) for t, w in zip(part, whole)]
            split = [[] if w or p else PIECES.findall(t) for t, w, p in zip(part, whole, plain)]
            odd = self._learn(set().union(*split))
            ids = self.known.__getitem__
            for text, pieces, w, p in zip(part, split, whole, plain):
                if p:
                    yield _bytes(self.merge(text))
                elif w or odd and not odd.isdisjoint(pieces):
                    yield self._raw(text)
                else:
                    yield b"".join(map(ids, pieces))

    def _learn(self, pieces: set[str]) -> set[str]:
        """Encode the pieces that are not known; those that cannot be told from white space are given back instead."""
        known = self.known
        if len(known) > REMEMBERED:
            known = Pieces()
            known.older, self.known = dict(self.known), known
        new = [p for p in pieces if p not in known and p not in known.older]
        odd = {p for p in new if UNSURE.search(p)}
        if odd:
            new = [p for p in new if p not in odd]
        if self.merge:
            rare = []
            for piece in new:
                if RARE.search(piece):
                    rare.append(piece)
                else:
                    known[piece] = _bytes(self.merge(piece))
            new = rare
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
            known[piece] = _bytes(found.ids)
        return odd


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
