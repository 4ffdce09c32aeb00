"""Exact whole-text encoding with a public byte-level BPE file, one word at a time through a cache."""

from __future__ import annotations

import json
import operator
import os
import re
from pathlib import Path

import numpy as np

from .common import CACHES, only

#: White space but for the space and the newline.
_ODD = re.compile(r"[^\S \n]")
#: Letters that are letters in every version of Unicode, then signs; the space or newline before them is in the key or not as in Encoder.words.
_SIGNS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_STEM = re.compile(rf"\n?[A-Za-zÀ-ÖØ-öø-ɏ]+[{re.escape(_SIGNS)}]+")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _unsafe(text: str) -> bool:
    """Two white-space characters side by side, or one at an end, or an odd one: there a word's ids may depend on what stands next to it."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or (any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text) is not None)


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them with add_special_tokens=False.

    The byte-level pre-tokenizer always cuts before a lone space and around a lone newline that stand between
    characters that aren't white space, so the ids of a text are those of its words in turn. Words are kept with their ids
    (up to max_words, some 240 MB, then the cache starts anew); a text with other white space or a special token's string, which the
    library takes for that token, is encoded in one piece. It also cuts between letters and the signs after them, so a new word that ends
    in signs shares the ids of its letters with the word without them.
    """

    def __init__(self, path: str, max_words: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(Path(path).read_text(encoding="utf-8"))
        self.cuts = not kind.get("normalizer") and (kind.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Ids that begin with a space, as a word's first after a space does and no other of it: where words begin among ids of many.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")] if self.cuts else []] = True
        self.max_words = max_words
        # Words after a space as they are, after a newline with it, and a text's first with a carriage return, which no word there begins with.
        self.words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}  # at a word's end
        self.texts: dict[str, bytes] = {}  # of late, whole: copies are common

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _parts(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """What is kept of words whose ids stand from begins to ends."""
        raw, n = ids.tobytes(), self.dtype.itemsize
        return [raw[a:z] for a, z in zip((begins * n).tolist(), (ends * n).tolist(), strict=True)]

    def __call__(self, text: str | None) -> bytes:
        """The ids as packed little-endian numbers of self.dtype."""
        return self.many([text])[0]

    def many(self, texts: list) -> list[bytes]:
        """The ids of several texts; words met for the first time are encoded together."""
        self._room()
        split, new, known, late, same = [], set(), self.words.get, [], self.texts.get
        for text in texts:
            if (ids := same(text)) is not None:
                split.append(ids)
                continue
            if not text or self._whole(text):
                split.append(text and self._ids(text) or b"")
                continue
            words = f"\r{text}".replace("\n", " \n").split(" ")
            ids = list(map(known, words))
            if None in ids:
                gaps = [i for i, x in enumerate(ids) if x is None]
                new.update([words[i] for i in gaps])
                late.append((ids, words, gaps))
            split.append(ids)
        if new:
            self._learn(new)
        for ids, words, gaps in late:
            for i in gaps:
                ids[i] = self.words[words[i]]
        out = [x if isinstance(x, bytes) else b"".join(x) for x in split]
        self._note(texts, out)
        return out

    def _room(self) -> None:
        """Before texts are encoded: full caches start anew."""
        if len(self.words) > self.max_words:
            self.words.clear()
            self.signs.clear()
        if len(self.texts) > 4096:
            self.texts.clear()

    def _whole(self, text: str) -> bool:
        """Whether a text has to be encoded in one piece."""
        return _unsafe(text) or bool(self.special and self.special.search(text))

    def _note(self, texts: list, out: list) -> None:
        self.texts.update((t, x) for t, x in zip(texts, out, strict=True) if t and len(t) < 10_000)

    def _learn(self, new: set[str]) -> None:
        """Encodes new words of a kind as one text with newlines between, which are ids of their own and part the result."""
        whole = [w for w in new if not w[-1:].isalnum() and _STEM.fullmatch(w)] if self.cuts else []
        stems = [w.rstrip(_SIGNS) for w in whole]
        tails = [w[len(a) :] for w, a in zip(whole, stems, strict=True)]
        if whole:
            new = new.difference(whole).union(set(stems).difference(self.words))
            self.signs.update((z, self._ids(z)) for z in set(tails).difference(self.signs))
        kinds: dict[str, list[str]] = {"\n": [], "\r": [], " ": []}
        for w in new:
            kinds[w[:1] if w[:1] in kinds else " "].append(w)
        for w in kinds["\r"]:
            self.words[w] = self._ids(w[1:])
        mark = self.tokenizer.encode("\n", add_special_tokens=False).ids
        for kind, own in ((k, kinds[k]) for k in ("\n", " ")):
            for i in range(0, len(own), 20_000):
                group = own[i : i + 20_000]
                bare = kind == " " and self.cuts  # spaces part the result already
                text = "".join(group) if kind == "\n" else " " + " ".join(group) if bare else "\n " + "\n ".join(group)
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                cuts = np.flatnonzero(self.spaced[ids] if bare else ids == mark[0])
                if not bare and len(mark) != 1 or len(cuts) != len(group):  # another vocabulary: word by word
                    self.words.update((w, self._ids(w if kind == "\n" else f" {w}")) for w in group)
                    continue
                self.words.update(zip(group, self._parts(ids, cuts + (kind == " " and not bare), np.append(cuts[1:], len(ids))), strict=True))
        self.words.update(zip(whole, map(operator.add, map(self.words.__getitem__, stems), map(self.signs.__getitem__, tails)), strict=True))


class _Known(dict):
    """Numbers by word; a word that isn't known is noted and counts as 0."""

    def __init__(self):
        self.missed: list[str] = []

    def __missing__(self, word: str) -> int:
        self.missed.append(word)
        return 0


class Lengths(Encoder):
    """Numbers of a text's ids alone: a word is kept with a small number, and no ids are put together."""

    def __init__(self, path: str, max_words: int = 1_200_000):
        super().__init__(path, max_words)
        self.words: dict[str, int] = _Known()
        self.signs: dict[str, int] = {}
        self.texts: dict[str, int] = {}

    def _ids(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _parts(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[int]:
        return (ends - begins).tolist()

    def many(self, texts: list) -> list[int]:
        """The numbers of ids of several texts; words met for the first time are encoded together."""
        self._room()
        out, late, same, known = [], [], self.texts.get, self.words.__getitem__
        for text in texts:
            if (n := same(text)) is None:
                if not text or self._whole(text):
                    n = self._ids(text) if text else 0
                else:
                    n = sum(map(known, f"\r{text}".replace("\n", " \n").split(" ")))
                    if self.words.missed:
                        late.append((len(out), self.words.missed))
                        self.words.missed = []
            out.append(n)
        if late:
            self._learn(set().union(*(words for _, words in late)))
        for i, words in late:
            out[i] += sum(map(known, words))
        self._note(texts, out)
        return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[tuple[str, type], Encoder] = CACHES.setdefault("encoders", {})


def encoder(path: str, max_words: int = 1_200_000, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder a worker, file and kind, with room for so many words."""
    only("encoders")
    key = path, kind
    if key not in _encoders:
        _encoders[key] = kind(path)
    _encoders[key].max_words = max_words
    return _encoders[key]
