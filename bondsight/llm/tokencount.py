"""Operator 8, token counts: Viterbi over a unigram vocabulary, carrying score and piece count but no path.

White-space words, each led by the word mark, are spelled by vocabulary pieces so that the summed scores are highest.
An Aho-Corasick automaton over bytes names, at every byte, the pieces that end there, longest first; the best score
and its number of pieces are carried from byte to byte. Every distinct word of a batch is solved once, many words side
by side. The rules are those of the tokenizers library's Unigram: of equal scores the longest piece stays; a character
that is no piece may be passed at the lowest score less 10, and then counts one piece for each of its bytes.

Null and empty texts have no words and no pieces. Rows are counted one by one, equal rows alike; empty tables give no
rows; columns other than doc_id and text are not read, whatever their names. The automaton's table has a row for each vocabulary prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bondsight.llm import shared
from bondsight.llm.arrays import flat, pieces, word_hashes, words

MARK = "▁".encode()
UNKNOWN = 10.0
CELLS = 2_000_000
OUT = "doc_id long, n_words long, n_pieces long, score double"


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """A sentencepiece file's ordinary pieces in their order, scored as Zipf's law has it: the log of 1 / rank, scaled to sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    share = 1 / np.arange(1, len(own) + 1)
    return list(zip(own, np.log(share / share.sum()).tolist(), strict=True))


class Automaton:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        coded = [(p.encode(), s) for p, s in vocabulary]
        seen = np.unique(np.frombuffer(b"".join(p for p, _ in coded), np.uint8))
        self.column = np.zeros(256, np.int64)
        self.column[seen] = np.arange(1, len(seen) + 1)
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, (p, _) in enumerate(coded):
            at = 0
            for b in p:
                at = child[at].setdefault(b, len(child))
                if at == len(child):
                    child.append({})
                    piece.append(-1)
            piece[at] = k
        self.go = np.zeros((len(child), len(seen) + 1), np.int32)
        fail = np.zeros(len(child), np.int32)
        ends = np.array(piece)
        #: The longest piece that ends here is that of state `ends`; shorter ones follow by `shorter`. -1: none.
        self.longest, self.shorter = np.full(len(child), -1), np.full(len(child), -1)
        level = [0]
        while level:
            below = []
            for s in level:
                f = fail[s]
                if s:
                    self.go[s] = self.go[f]
                self.shorter[s] = self.longest[f] if s else -1
                self.longest[s] = s if ends[s] >= 0 else self.shorter[s]
                for b, t in child[s].items():
                    fail[t] = self.go[s, self.column[b]] if s else 0
                    self.go[s, self.column[b]] = t
                    below.append(t)
            level = below
        self.size = np.array([len(coded[k][0]) if k >= 0 else 0 for k in piece])
        self.score = np.array([coded[k][1] if k >= 0 else 0.0 for k in piece])
        self.unknown = min((s for _, s in coded), default=0.0) - UNKNOWN

    def solve(self, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score and its number of pieces, of words of bytes padded to equal length."""
        n, width = grid.shape
        best, count = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0
        state = np.zeros(n, np.int64)
        begin, alone = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(width):
            byte = grid[:, j]
            lead = (byte & 0xC0) != 0x80
            begin[lead] = j
            state = self.go[state, self.column[byte]]
            alone[:] = False
            who, at = np.arange(n), self.longest[state]
            while True:
                on = at >= 0
                who, at = who[on], at[on]
                if not len(who):
                    break
                from_ = j + 1 - self.size[at]
                fits = best[who, from_] + self.score[at]
                win = fits > best[who, j + 1]
                best[who[win], j + 1] = fits[win]
                count[who[win], j + 1] = count[who[win], from_[win]] + 1
                alone[who[from_ == begin[who]]] = True
                at = self.shorter[at]
            last = (grid[:, j + 1] & 0xC0) != 0x80 if j + 1 < width else np.ones(n, bool)
            who = np.flatnonzero(last & ~alone & (j < size))
            fits = best[who, begin[who]] + self.unknown
            win = fits > best[who, j + 1]
            who, fits = who[win], fits[win]
            best[who, j + 1] = fits
            count[who, j + 1] = count[who, begin[who]] + j + 1 - begin[who]
        row = np.arange(n)
        return best[row, size], count[row, size]


def _counted(vocabulary):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(vocabulary.value)
        for batch in pieces(batches):
            data, off = flat(batch.column("text"))
            start, end, first = words(data, off)
            _, one, of = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
            start, size = start[one], (end - start)[one]
            best, count = np.zeros(len(one)), np.zeros(len(one), np.int64)
            order, at = np.argsort(size, kind="stable"), 0
            while at < len(order):
                most = int(np.searchsorted(size[order[at:]] * np.arange(1, len(order) - at + 1), CELLS)) or 1
                some = order[at : at + most]
                width = int(size[some].max())
                grid = np.full((len(some), width + len(MARK)), 0x20, np.uint8)
                grid[:, : len(MARK)] = np.frombuffer(MARK, np.uint8)
                inside = np.arange(width) < size[some][:, None]
                grid[:, len(MARK) :][inside] = data[(start[some][:, None] + np.arange(width))[inside]]
                best[some], count[some] = machine.solve(grid, size[some] + len(MARK))
                at += most
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.bincount(row, count[of], len(batch)).astype(np.int64)), pa.array(np.bincount(row, best[of], len(batch))),
            ], names=["doc_id", "n_words", "n_pieces", "score"])

    return counted


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """One row for each row of docs: its words, the pieces that spell them best, and their summed score."""
    spark = shared.session(docs)
    return shared.documents(docs).mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), OUT)
