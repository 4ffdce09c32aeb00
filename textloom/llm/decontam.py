"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (the documents of a batch) gets a suffix array: its word positions sorted by the words that follow. Every suffix
of every benchmark item with a window's words left is searched in it by halves; the equal range gives all its occurrences, and walking on
from them the longest verbatim match and its place. A suffix that starts with words of which one occurs in no item can't match, so
such positions stay out of the array. Matches shorter than a window aren't looked for.
"""

from __future__ import annotations

import hashlib
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, only, scratch, small_batches, text_or_empty, trim
from .tokens import open_path

WINDOW = 10
#: Bytes of item texts in a block; every shard is searched for one block after the other.
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1_000_000
#: A-Z become a-z; all ASCII but letters and digits parts words; other bytes belong to characters that are in words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """Items of a block: their words as numbers, and for each window width the packed first words of every suffix."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.item_ids, self.words, self.tests = [], [], {}
        by_width: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1] or "")):  # the first of equal matches is the least item's
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                width = min(window, len(ids))
                by_width.setdefault(width, []).extend((len(self.words), i) for i in range(len(ids) - width + 1))
                self.item_ids.append(item_id)
                self.words.append(ids)
        self.bits = max(1, len(self.vocab).bit_length())
        for width, places in by_width.items():
            rows = np.stack([self.words[k][i : i + width] for k, i in places])
            keys, at = np.unique(pack_words(rows, self.bits), return_inverse=True)
            order = np.argsort(at, kind="stable")
            self.tests[width] = (keys, np.searchsorted(at[order], np.arange(len(keys) + 1)), np.array(places)[order])


def pack_words(rows: np.ndarray, bits: int) -> np.ndarray:
    """Rows of word numbers as byte strings of equal length that sort as the rows do."""
    each = 64 // bits
    cols = []
    for i in range(0, rows.shape[1], each):
        x = np.zeros(len(rows), np.uint64)
        for j in range(i, min(i + each, rows.shape[1])):
            x = (x << np.uint64(bits)) | rows[:, j].astype(np.uint64)
        cols.append(x)
    raw = np.stack(cols, 1).astype(">u8")
    return np.ascontiguousarray(raw).view(f"S{8 * len(cols)}").ravel()


def suffix_array(ids: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which width known words follow, sorted by these, and their packed words. ids: 0 for other words."""
    n = len(ids)
    ends = np.flatnonzero(ids == 0)
    stop = np.append(ends, n)[np.searchsorted(ends, np.arange(n))]
    at = np.flatnonzero(stop - np.arange(n) >= width)
    keys = pack_words(ids[at[:, None] + np.arange(width)], bits) if len(at) else np.zeros(0, "S8")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search_shard(ids: np.ndarray, starts: np.ndarray, block: Block) -> tuple[np.ndarray, dict[int, set], np.ndarray, np.ndarray, np.ndarray]:
    """hit words of the shard; items by document; and by document the longest match: its words, item and position."""
    hit = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set] = {}
    longest, which, where = (np.full(len(starts), v, np.int64) for v in (0, -1, -1))
    for width, (keys, bounds, places) in block.tests.items():
        at, own = suffix_array(ids, width, block.bits)
        low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
        for k in np.flatnonzero(high > low):
            found = at[low[k] : high[k]]
            np.add.at(hit, found, 1)
            np.add.at(hit, np.minimum(found + width, len(ids)), -1)
            docs = np.searchsorted(starts, found, "right") - 1
            for item, i in places[bounds[k] : bounds[k + 1]]:
                for d in np.unique(docs):
                    items.setdefault(int(d), set()).add(int(item))
                word, n, go = block.words[item], np.full(len(found), width), np.arange(len(found))
                while len(go):
                    n_go = n[go]
                    go = go[(i + n_go < len(word)) & (found[go] + n_go < len(ids))]
                    go = go[ids[found[go] + n[go]] == word[i + n[go]]]
                    n[go] += 1
                for q in np.flatnonzero(n >= longest[docs]):
                    d, m, place = docs[q], n[q], found[q] - starts[docs[q]]
                    if (-m, item, place) < (-longest[d], which[d], where[d]):
                        longest[d], which[d], where[d] = m, item, place
    return np.cumsum(hit)[:-1] > 0, items, longest, which, where


def write_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Items as files of bounded size in the shared folder, streamed through the driver a partition at a time."""
    import json

    folder, paths, held, size = scratch(benchmark.sparkSession, "benchmark"), [], [], 0

    def put() -> None:
        paths.append(f"{folder}/{len(paths)}.json")
        with open_path(paths[-1], "wb") as out:
            out.write(json.dumps(held).encode())

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    for r in rows.where("text <> ''").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_bytes:
            put()
            held, size = [], 0
    if held:
        put()
    return paths


_blocks: dict[tuple[str, int], Block] = CACHES.setdefault("blocks", {})


def _block(path: str, window: int) -> Block:
    """The block of a file; a worker keeps one."""
    import json

    if (path, window) not in _blocks:
        _blocks.clear()
        with open_path(path) as stream:
            _blocks[path, window] = Block([tuple(x) for x in json.loads(io.BytesIO(stream.read()).getvalue())], window)
    return _blocks[path, window]


MATCH = "n_words long, n_hit long, n_items long, items_sha256 string, longest_words long, longest_item_id string, longest_at long"


def matcher(benchmark: DataFrame, window: int = WINDOW):
    """A column function: text -> struct of MATCH."""
    small_batches(benchmark.sparkSession)
    paths = write_blocks(benchmark)

    @F.pandas_udf(f"struct<{', '.join(x.strip().replace(' ', ':') for x in MATCH.split(','))}>")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only("blocks")
        for part in parts:
            rows, texts, i = [], part.tolist(), 0
            while i < len(texts):
                shard, n = [], 0
                while i < len(texts) and n < SHARD_WORDS:
                    shard.append(words_of(texts[i]))
                    n += len(shard[-1])
                    i += 1
                starts = np.cumsum([0, *(len(w) + 1 for w in shard)])
                hits = np.zeros(starts[-1], bool)
                items: list[set] = [set() for _ in shard]
                best = [(0, None, None)] * len(shard)
                for path in paths:
                    block = _block(path, window)
                    ids = np.zeros(starts[-1], np.int64)
                    for a, w in zip(starts, shard, strict=False):
                        ids[a : a + len(w)] = np.fromiter(map(block.vocab.get, w, itertools.repeat(0)), np.int64, len(w))
                    hit, found, longest, which, where = search_shard(ids, starts[:-1], block)
                    hits |= hit
                    for d, own in found.items():
                        items[d] |= {block.item_ids[k] for k in own if block.item_ids[k] is not None}
                        mine = int(longest[d]), block.item_ids[which[d]], int(where[d])
                        best[d] = min(best[d], mine, key=lambda x: (-x[0], x[1] is None, x[1] or "", x[2] if x[2] is not None else -1))
                for d, w in enumerate(shard):
                    a = starts[d]
                    ids_of = ",".join(sorted(items[d]))
                    rows.append((len(w), int(hits[a : a + len(w)].sum()), len(items[d]), hashlib.sha256(ids_of.encode()).hexdigest(), *best[d]))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in MATCH.split(",")])
            out["longest_at"] = out["longest_at"].astype("Int64")
            yield out
        trim()

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of docs: doc_id, the columns of MATCH and contaminated (n_hit > 0).

    A window is window consecutive words of an item, or a shorter item as a whole. A document's word is hit if it lies in
    an occurrence of a window; n_items counts distinct items with occurring windows; longest_* tell the longest verbatim
    match of at least a window: its words, its item (of several that have it the least as a string, null last) and its first place in the
    document, in words from 0; 0 and null without one. Null texts have no words; items with a null item_id
    mark hits but aren't listed; repeated items count once; an empty benchmark hits nothing.
    """
    m = docs.select("doc_id", matcher(benchmark, window)(text_or_empty()).alias("m"))
    return m.select("doc_id", "m.*").withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a benchmark window, with their own columns."""
    return docs.where(matcher(benchmark, window)(text_or_empty()).getField("n_hit") == 0)
