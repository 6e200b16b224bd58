"""Byte-pair encoding as a deterministic automaton, and the operators over it (problem 7).

Construction.  Start from the one-state automaton that accepts every sequence of
byte tokens.  Process the merges ``(u, v) -> w`` in rank order; each adds a merge
gadget: the state reached by reading ``u`` is copied without its arc ``v`` (the pair
must have been merged), every state with an arc ``u`` gets an arc ``w``, and ``w``
leads to the state that ``v`` led to.  By induction the state reached depends on
the last arc label alone, so a state *is* a token, and the gadgets leave this
arc relation:

* a pair of bytes is an arc unless it is itself a merge;
* an arc between two tokens held before gadget ``k`` is lost if gadget ``k`` merges them;
* the arc ``(p, w_k)`` is a copy of ``(p, u_k)`` taken after gadget ``k``'s cut;
* the arc ``(w_k, t)`` is a copy of ``(v_k, t)`` taken before gadget ``k``'s cut.

``BpeAutomaton.arc`` evaluates that relation by walking the gadgets backwards and
memoises it, so only the rows a corpus uses are materialised (50k x 50k bits would
otherwise be 300 MB a worker).  The byte level is a table (a trie over the arc
labels' bytes).  Reading a pre-split word keeps, for each byte offset, the one state
the automaton can be in; the arc labels on the accepting path are the ids.  Decoding
emits the arc labels' bytes.

Words are memoised as well: a corpus repeats its words, so the transitions run once
a distinct word and worker.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pre-split pattern published with the rank files.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the public vocabularies lie when no path is given.
DEFAULT_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCAB = "byte_bpe_50k.tiktoken"
#: Distinct words of a generation that a worker remembers (it keeps two), and the longest it remembers.
WORD_MEMO = 300_000
MEMO_CHARS = 40
#: Arcs of a generation that a worker remembers; two generations take some 200 MB at most.
ARC_MEMO = 1_000_000

_LOADED: dict[str, "BpeAutomaton"] = {}


class BpeAutomaton:
    """Deterministic automaton of a byte-level rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.label = {i: b for b, i in ranks.items()}
        self.birth: dict[int, int] = {}  # gadget that made a token; bytes: -1
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> gadget
        self._build()
        self._arcs: dict[int, bool] = {}
        self._old_arcs: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._old_chunks: dict[str, tuple[int, ...]] = {}  # the generation before
        self._old_words: dict[str, tuple[int, ...]] = {}
        self._go: dict[int, int] = {}  # node << 8 | byte -> node
        self._final: list[int] = [-1]  # node -> arc label that ends there, or -1
        for tok, rank in ranks.items():
            node = 0
            for b in tok:
                nxt = self._go.get(node << 8 | b)
                if nxt is None:
                    nxt = self._go[node << 8 | b] = len(self._final)
                    self._final.append(-1)
                node = nxt
            self._final[node] = rank

    @classmethod
    def from_file(cls, path: str) -> "BpeAutomaton":
        if path not in _LOADED:
            with open(path, "rb") as f:
                _LOADED[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        return _LOADED[path]

    def _build(self) -> None:
        """Add the gadgets in rank order. A label's two halves are its encoding by the gadgets so far."""
        for tok, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(tok) == 1:
                self.birth[rank] = -1
                continue
            parts = [self.ranks[tok[i : i + 1]] for i in range(len(tok))]
            while len(parts) > 2:
                best = min(
                    (g, i) for i in range(len(parts) - 1) if (g := self.merge.get((parts[i], parts[i + 1]), 1 << 60)) < rank
                )[1]
                parts[best : best + 2] = [self.ranks[self.label[parts[best]] + self.label[parts[best + 1]]]]
            self.left[rank], self.right[rank] = parts
            self.birth[rank] = rank
            self.merge[(parts[0], parts[1])] = rank

    def arc(self, p: int, t: int) -> bool:
        """Does the state reached by ``p`` have an arc ``t``?"""
        key = p << 20 | t
        got = self._arcs.get(key)
        if got is None:
            got = self._old_arcs.get(key)
        if got is None:
            before = 1 << 60  # gadgets below this rank count
            while True:
                g = self.merge.get((p, t))
                if g is not None and g < before:
                    got = False
                    break
                bp, bt = self.birth[p], self.birth[t]
                if bp < 0 and bt < 0:
                    got = True
                    break
                if bp > bt:
                    before, p = bp, self.right[p]
                else:
                    before, t = bt + 1, self.left[t]
        if len(self._arcs) > ARC_MEMO:
            self._old_arcs, self._arcs = self._arcs, {}
        self._arcs[key] = got
        return got

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Run the byte table from every offset that has a state; the last offset's path is the encoding."""
        if (whole := self.ranks.get(word)) is not None:
            return (whole,)
        n, go, final, arcs, arc = len(word), self._go, self._final, self._arcs, self.arc
        state = [-1] * n + [-1]
        back = [0] * (n + 1)
        for start in range(n):
            s = state[start]
            if start and s < 0:
                continue
            node, end = 0, start
            while end < n:
                node = go.get(node << 8 | word[end])
                if node is None:
                    break
                end += 1
                tok = final[node]
                if tok >= 0 and state[end] < 0:
                    if start:
                        ok = arcs.get(s << 20 | tok)
                        if not (arc(s, tok) if ok is None else ok):
                            continue
                    state[end], back[end] = tok, start
        out, at = [], n
        while at:
            out.append(state[at])
            at = back[at]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give no ids.

        A space after a non-space always begins a piece of the pre-split, so a text in
        which no blank precedes a space is cut at its spaces first and whole chunks are
        looked up; other texts go through the pattern as a whole.
        """
        if not text:
            return []
        if _BLANK_SPACE(text):
            return list(itertools.chain.from_iterable(map(self._piece, _splitter()(text))))
        first, *rest = text.split(" ")
        memo = self._chunks
        try:
            found = [memo[w] for w in rest]
        except KeyError:
            found = [memo[w] if w in memo else self._chunk(w) for w in rest]
        return list(itertools.chain(self._cut(first), itertools.chain.from_iterable(found)))

    def _cut(self, chunk: str) -> tuple[int, ...]:
        return tuple(itertools.chain.from_iterable(map(self._piece, _splitter()(chunk))))

    def _chunk(self, w: str) -> tuple[int, ...]:
        ids = self._old_chunks.get(w)
        if ids is None:
            ids = self._cut(" " + w)
        if len(w) <= MEMO_CHARS:
            if len(self._chunks) > WORD_MEMO:
                self._old_chunks, self._chunks = self._chunks, {}
            self._chunks[w] = ids
        return ids

    def _piece(self, w: str) -> tuple[int, ...]:
        ids = self._words.get(w)
        if ids is None:
            ids = self._old_words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
            if len(w) <= MEMO_CHARS:
                if len(self._words) > WORD_MEMO:
                    self._old_words, self._words = self._words, {}
                self._words[w] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Emit the arc labels."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_BLANK_SPACE = re.compile(r"\s ").search
_SPLIT = None


def _splitter():
    global _SPLIT
    if _SPLIT is None:
        import regex

        _SPLIT = regex.compile(PRE_SPLIT).findall
    return _SPLIT


def vocab_path(path: str | None = None) -> str:
    return path or os.path.join(DEFAULT_DIR, DEFAULT_VOCAB)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """One row a row of ``df``: ``id_col`` and ``ids``, without special tokens.

    Null and empty texts get an empty list, blank texts the ids of their blanks; texts
    that spell a special token are ordinary text. Rows that repeat stay repeated; other
    columns are not read. A narrow map: no shuffle, one pass, whole texts. The vocabulary
    file must be readable on every worker at ``vocab``.
    """
    path = vocab_path(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = BpeAutomaton.from_file(path)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat += auto.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row (0 for null and empty texts). No shuffle."""
    path = vocab_path(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = BpeAutomaton.from_file(path)
        for batch in batches:
            n = [len(auto.encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of each list of ids; null lists give null, empty lists an empty text."""
    path = vocab_path(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = BpeAutomaton.from_file(path)
        for batch in batches:
            texts = [None if x is None else auto.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
