"""Byte-level BPE by speculation and verification.

1. Texts are cut into words by the vocabulary's pattern; only words not seen
   before in the worker are encoded.
2. Greedy longest match proposes tokens for all new words in one pass of an
   automaton (every byte is a token, so a proposal always exists).
3. A token sequence is the BPE encoding of its bytes exactly if each adjacent pair
   is the encoding of its own bytes. All distinct pairs are tested at once with
   array operations on the merge table; the verdicts are kept.
4. Words with a pair that fails are merged exactly.

Defined cases: an empty and a null text have no ids (an empty list); blank texts
are encoded like any other; texts are never shortened.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

#: Where the public vocabularies are, unless a caller says otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker; when there are more, the worker starts again with none.
KEPT_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters by which a vocabulary file writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encoder over the vocabulary file ``path`` (JSON with a vocabulary and merges)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        specials = {"<|endoftext|>"}
        vocabulary = {w: i for w, i in model["vocab"].items() if w not in specials}
        size = max(vocabulary.values()) + 1
        self.size = size
        self.split = regex.compile(PATTERN).findall
        # left[i], right[i]: the tokens that a merge joins to i; a single byte is its own part
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.rank = np.zeros(size, dtype=np.int64)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            l, r, i = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[l, r] = (rank, i)
            self.left[i], self.right[i], self.rank[i] = l, r, rank
        keys = np.array([l * size + r for l, r in self.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merged.values()], dtype=np.int64)[order]
        self.byte_ids = [0] * 256
        self.automaton = ahocorasick.Automaton()
        for word, i in vocabulary.items():
            raw = bytes(letters[c] for c in word)
            if len(raw) == 1:
                self.byte_ids[raw[0]] = i
            self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.words: dict[str, list[int]] = {}
        self.verdicts: dict[int, bool] = {}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the encoding of the bytes of a[i] and b[i] the pair itself? For all i at once.

        The merges of both tokens are undone from the last to the first. At each
        moment the two tokens that touch must not be joined by a merge that comes
        before the next merge on their own side of the boundary would have.
        """
        ok = np.ones(len(a), dtype=bool)
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            bad = self._pair_rank(xs, ys) < limit[live]
            ok[live[bad]] = False
            live, xs, ys = live[~bad], xs[~bad], ys[~bad]
            rx, ry = self.rank[xs], self.rank[ys]
            ended = (rx == 0) & (ry == 0)
            live, xs, ys, rx, ry = live[~ended], xs[~ended], ys[~ended], rx[~ended], ry[~ended]
            # the later of the two last merges is undone; at equal ranks the right one, as equal pairs merge from the left
            undo_left = rx > ry
            x[live] = np.where(undo_left, self.right[xs], xs)
            y[live] = np.where(undo_left, ys, self.left[ys])
            # a pair across the boundary wins over the undone merge on its right at equal rank, as it begins further left
            limit[live] = np.where(undo_left, rx, ry + 1)
        return ok

    def exact(self, raw: bytes) -> list[int]:
        """BPE of a word by merging the pair of lowest rank again and again, leftmost first."""
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        queue = []
        for i in range(n - 1):
            if m := self.merged.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merged[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for l, r in ((before[i], i), (i, after[i])):
                if l >= 0 and r >= 0 and (m := self.merged.get((ids[l], ids[r]))):
                    heapq.heappush(queue, (m[0], l, ids[l], ids[r]))
        return [t for t, a in zip(ids, alive) if a]

    def learn(self, words: list[str]) -> None:
        """Encodes new words into the worker's store."""
        if not words:
            return
        raws = [w.encode("utf-8") for w in words]
        # a letter that is no byte keeps matches from crossing words
        joined = "Ā".join(r.decode("latin-1") for r in raws)
        found = [(end, token) for end, (token, _) in self.automaton.iter_long(joined)]
        ends = np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found))
        tokens = np.fromiter((t for _, t in found), dtype=np.int64, count=len(found))
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        last = np.cumsum(lengths + 1) - 2  # where each word ends in ``joined``
        of = np.searchsorted(last, ends)
        same = of[1:] == of[:-1]
        pairs = tokens[:-1] * self.size + tokens[1:]
        distinct, inverse = np.unique(pairs[same], return_inverse=True)
        verdict = np.fromiter((self.verdicts.get(int(p), -1) for p in distinct), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(verdict < 0)
        if len(new):
            verdict[new] = self.compatible(distinct[new] // self.size, distinct[new] % self.size)
            if len(self.verdicts) > 4 * KEPT_WORDS:
                self.verdicts.clear()
            self.verdicts.update(zip(distinct[new].tolist(), verdict[new].tolist()))
        failing = np.zeros(len(words), dtype=bool)
        failing[of[1:][same][verdict[inverse] == 0]] = True
        cuts = np.searchsorted(of, np.arange(len(words) + 1))
        listed = tokens.tolist()
        for k, w in enumerate(words):
            self.words[w] = self.exact(raws[k]) if failing[k] else listed[cuts[k] : cuts[k + 1]]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null one."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        self.learn([w for w in dict.fromkeys(w for words in split for w in words) if w not in known])
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; it lives as long as the worker."""
    return Encoder(path)


def _chunks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that long texts don't pile up."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids: the token ids of each document's whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            texts, docs = batch.column(1).to_pylist(), batch.column(0)
            for a, b in _chunks(texts):
                ids = enc.encode_all(texts[a:b])
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([docs[a:b], lists], names=["doc_id", "ids"])

    return documents.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, tokens: the number of token ids of each document's whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for a, b in _chunks(texts):
                counts += [len(x) for x in enc.encode_all(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return documents.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")
