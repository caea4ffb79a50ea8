"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links as in Aho-Corasick matching, and with each link the number of
tokens that are complete when it is followed. One pass over a word's characters then gives the number of
pieces of greedy longest-match-first tokenization; no piece is built. For the characters that make up
nearly all text the links are resolved beforehand into a dense table, and numpy advances all words of a
block together; words with other characters walk the same links one by one.

Words are runs of letters, digits and underscores, or single other characters that aren't white space. A
word that can't be covered counts as one unknown token.

Results for odd input: null and empty texts have no words and no tokens. Very long texts are counted in
parts cut at white space, with the same sums; a word however long is one word. Ties don't arise. Rows are counted one by one,
repeated or not. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import table
from artiscope.llm._worker import worker

#: Characters below this number have a column in the dense table if the vocabulary has them.
DENSE = 0x250
#: Characters of text that are worked on together.
BLOCK = 1 << 20
SPACE, SINGLE, WORD = 0, 1, 2


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that go on, from a sentencepiece model: a mark says that a piece begins a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, more = set(), set()
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        (begin if piece[0] == "▁" else more).add(piece.lstrip("▁"))
    more -= {""}
    return sorted((begin | more) - {""}), sorted(more)


class Automaton:
    """Trie with failure links. Node 0 begins words, node 1 goes on with them; -1 is dead."""

    def __init__(self, begin: Iterable[str], more: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        self.longest = 1
        for root, pieces in ((0, begin), (1, more)):
            for piece in pieces:
                self.longest = max(self.longest, len(piece))
                at = root
                for c in piece:
                    nxt = self.goto[at].get(c)
                    if nxt is None:
                        nxt = self.goto[at][c] = len(self.goto)
                        self.goto.append({})
                        token.append(False)
                    at = nxt
                token[at] = True
        n = len(self.goto)
        self.fail, self.pops = [-1] * n, [0] * n
        level, order = [0, 1], [1, 0]
        while level:
            below = []
            for u in level:
                for c, v in self.goto[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.goto[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.goto[z][c], popped
            order += below
            level = below
        self.finish = [-1] * n  # tokens popped from a node at a word's end
        self.finish[1] = self.finish[0] = 0
        for v in order:
            if v > 1 and self.fail[v] >= 0 and self.finish[self.fail[v]] >= 0:
                self.finish[v] = self.pops[v] + self.finish[self.fail[v]]
        self._order = order

    def count(self, word: str) -> int:
        """Pieces of one word; -1 if the vocabulary doesn't cover it."""
        at = total = 0
        for c in word:
            while c not in self.goto[at]:
                if self.fail[at] < 0:
                    return -1
                total += self.pops[at]
                at = self.fail[at]
            at = self.goto[at][c]
        return total + self.finish[at] if self.finish[at] >= 0 else -1

    def dense(self) -> None:
        """Tables for the common characters: the class of a character, next node and popped tokens by node and class."""
        chars = sorted({c for edges in self.goto for c in edges if ord(c) < DENSE})
        self.cls = np.zeros(DENSE, np.int64)  # class 0: no edge has it
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: k + 1 for k, c in enumerate(chars)}
        n, width = len(self.goto), len(chars) + 1
        counter = np.min_scalar_type(self.longest)  # nothing pops more tokens than a piece has characters
        self.next, self.popped = np.full((n + 1, width), n, np.int32), np.zeros((n + 1, width), counter)  # row n: dead
        for v in self._order:
            f = self.fail[v]
            if f >= 0:
                self.next[v], self.popped[v] = self.next[f], self.popped[f] + self.pops[v]
            own = [(at[c], u) for c, u in self.goto[v].items() if c in at]
            if own:
                k, u = map(list, zip(*own))
                self.next[v, k], self.popped[v, k] = u, 0
        self.end = np.array([*self.finish, -1], np.int64)
        self.width, self.dead = width, n
        self._kinds: dict[int, int] = {}

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """SPACE, SINGLE or WORD for each character."""
        uniq, back = np.unique(codes, return_inverse=True) if len(codes) and codes.max() >= DENSE else (np.arange(DENSE), codes)
        for c in uniq.tolist():
            if c not in self._kinds:
                x = chr(c)
                self._kinds[c] = WORD if x.isalnum() or x == "_" else SPACE if x.isspace() else SINGLE
        return np.array([self._kinds[c] for c in uniq.tolist()], np.int8)[back]

    def block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and piece counts of the words of a text; -1 for those not covered."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kinds(codes)
        start = kind != SPACE
        start[1:] &= (kind[1:] == SINGLE) | (kind[:-1] != WORD)
        starts = np.flatnonzero(start)
        stop = np.flatnonzero(np.append((kind[1:] != kind[:-1]) | (kind[1:] == SINGLE), True)) + 1
        ends = stop[np.searchsorted(stop, starts, side="right")]
        rare = codes >= DENSE
        sums = np.concatenate([[0], np.cumsum(rare)])
        plain = sums[ends] == sums[starts]
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self.count(text[starts[k] : ends[k]])
        cls = self.cls[np.where(rare, 0, codes)]
        live = np.flatnonzero(plain)
        node, total, pos, last = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), starts[live], ends[live]
        nxt, popped = self.next.reshape(-1), self.popped.reshape(-1)
        while len(live):
            edge = node * self.width + cls[pos]
            total += popped[edge]
            node = nxt[edge].astype(np.int64)
            pos = pos + 1
            done = (pos == last) | (node == self.dead)
            if done.any():
                end = self.end[node[done]]
                out[live[done]] = np.where(end >= 0, total[done] + end, -1)
                go = ~done
                live, node, total, pos, last = live[go], node[go], total[go], pos[go], last[go]
        return starts, out


_BUILT: dict[int, Automaton] = {}


def automaton(key: int, vocabulary_: tuple[list[str], list[str]]) -> Automaton:
    """This worker's automaton of a vocabulary, built once; a function of this module, so that tasks don't bring tables along."""
    auto = _BUILT.get(key)
    if auto is None:
        _BUILT.clear()
        auto = _BUILT[key] = Automaton(*vocabulary_)
        auto.dense()
    return auto


def forget() -> None:
    _BUILT.clear()


_GAP = re.compile(r"\s")


def blocks(texts: list[str | None], size: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, with their places in the list, in blocks of about ``size`` characters; longer texts are cut at white space, where no word goes on."""
    size = size or BLOCK
    owner: list[int] = []
    part: list[str] = []
    held = 0
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size:
                gap = _GAP.search(text, at + size)
                end = gap.end() if gap else end
            owner.append(k)
            part.append(text[at:end])
            held += end - at + 1
            at = end
            if held >= size:
                yield owner, part
                owner, part, held = [], [], 0
    if part:
        yield owner, part


def count_tokens(docs: DataFrame, begin: list[str], more: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens and n_unknown (words that the vocabulary doesn't cover; each is one token) for each row."""
    fed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast((begin, more))  # a vocabulary: its size doesn't depend on the data
    key = shared.id if hasattr(shared, "id") else id(shared)

    @worker("tokens", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(key, shared.value)
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for owner, part in blocks(batch.column(1).to_pylist()):
                starts, counts = auto.block("\n".join(part))
                edge = np.cumsum([len(t) + 1 for t in part])
                of = np.array(owner)[np.searchsorted(edge, starts, side="right")]
                for k, x in enumerate((np.ones(len(counts)), np.where(counts < 0, 1, counts), counts < 0)):
                    sums[k] += np.bincount(of, weights=x, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return fed.mapInArrow(run, T.StructType([fed.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown"))]))


def op3_token_count(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(vocab_path))


QUERIES = {"op3_token_count": op3_token_count}
