"""Op 1: SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie in one flat symbol array. Each round takes
the minimum pair rank of every word (segmented minimum), merges its leftmost
occurrence in all words at once, and compacts the arrays; words without a
mergeable pair leave. One leftmost merge per word and round is exactly the
library's order, in which a merge may create a better pair than the last one.

Edge cases: a null or empty text has no ids and decodes to the empty text;
characters outside the vocabulary become byte pieces; words of more than
LONG_WORD symbols are merged with a priority queue, in the same order (a round
per merge would be quadratic in their length). Rows are independent: repeated
rows give repeated results, an empty table an empty one. Only the id and text
columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from churnforge.llm.common import text_slices
from churnforge.llm.segments import SegmentStore, list_sums, spans
from churnforge.session import map_in_arrow

SPACE = "▁"
LONG_WORD = 256
_LAST, _INDEX = np.int64(2**62), np.int64(2**32 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PieceCodec:
    """Tables of a SentencePiece BPE model and the merge rounds over them."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces)
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans words; this model needs whole-text merging")
        # characters that occur only inside longer pieces get symbols past the vocabulary
        inner = sorted({c for p in normal for c in p} - normal.keys())
        self.symbols = {p: i for p, i in normal.items()} | {c: n + k for k, c in enumerate(inner)}
        self.n_ids, self.stride = n, n + len(inner) + 1
        self.other = self.stride - 1
        self.chars = {c: i for c, i in self.symbols.items() if len(c) == 1}
        levels = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in normal.values()}))}
        pairs = {}
        for p, i in normal.items():
            rank = levels[-sp.get_score(i)]
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.stride + b] = (rank, i)
        self._hash_pairs(pairs)
        raw = [b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        raw[sp.unk_id()] = " ⁇ ".encode()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lens = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.concatenate(([0], np.cumsum(self.raw_lens)[:-1]))

    def _hash_pairs(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Open-addressing table of pair -> (rank, merged symbol), about an
        eighth full so that most probes end at the first slot."""
        bits = (8 * len(pairs)).bit_length()
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(size + len(pairs), -1, np.int64)
        self.ranks = np.zeros(len(self.keys), np.int64)
        self.merged = np.zeros(len(self.keys), np.int64)
        for pair, slot in zip(pairs, self._slots(np.array(list(pairs), np.int64)).tolist()):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot] = pair
            self.ranks[slot], self.merged[slot] = pairs[pair]
        self.pair_dict = pairs

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    # -- encoding ---------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Words of a text; each stands for itself behind one space mark."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, pending = [], 0
        for p in parts:
            if p:
                out.append(SPACE * pending + p)
                pending = 0
            else:
                pending += 1
        if pending:
            out.append(SPACE * (pending - 1))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (each behind its space mark): flat ids and lengths."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) < LONG_WORD:
                short.append(k)
            else:
                out[k] = self._final(self._merge_queue(SPACE + w), SPACE + w)[0]
        if short:
            text = SPACE + SPACE.join(words[k] for k in short)
            sizes = np.array([len(words[k]) + 1 for k in short], np.int64)
            syms, origin = self._rounds(text, sizes)
            ids, lens = self._final_many(syms, origin, text, np.cumsum(sizes) - sizes)
            if len(short) == len(words):
                return ids, lens
            for k, part in zip(short, np.split(ids, np.cumsum(lens)[:-1])):
                out[k] = part
        lens = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), lens

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        uniq, back = np.unique(points, return_inverse=True)
        ids = np.array([self.chars.get(chr(c), self.other) for c in uniq], np.int64)
        return ids[back]

    def _pairs(self, sym: np.ndarray, left: np.ndarray, right: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index) keys of symbol pairs, and what each merges into."""
        pair = sym[left] * self.stride + sym[right]
        at = self._slots(pair)
        found = self.keys[at]
        other = np.flatnonzero((found != pair) & (found >= 0))
        while len(other):
            at[other] += 1
            found[other] = self.keys[at[other]]
            other = other[(found[other] != pair[other]) & (found[other] >= 0)]
        return np.where(found == pair, (self.ranks[at] << 32) | left, _LAST), self.merged[at]

    def _rounds(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; returns symbols and the text position
        at which each begins, in text order.

        A pair's key is (rank, index), so one segmented minimum finds each
        word's best pair and its leftmost place. Symbols merged away stay as
        gaps until a quarter of the array is gaps or finished words, then the
        arrays are compacted.
        """
        sym = self._symbols(text)
        pos = np.arange(len(sym), dtype=np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_sym, done_pos = [], []
        while len(sym):
            n = len(sym)
            index = np.arange(n, dtype=np.int64)
            joined = word[1:] == word[:-1]
            nxt = np.append(np.where(joined, index[1:], -1), -1)
            prv = np.append(-1, np.where(joined, index[:-1], -1))
            key, into = np.full(n, _LAST, np.int64), np.zeros(n, np.int64)
            inner = index[:-1][joined]
            key[inner], into[inner] = self._pairs(sym, inner, inner + 1)
            starts = np.concatenate(([0], index[1:][~joined]))
            gone, spare = np.zeros(n, bool), 0
            finished = np.zeros(n, bool)
            word_ends = np.append(starts[1:], n)
            while len(starts):
                best = np.minimum.reduceat(key, starts)
                live = best < _LAST
                if not live.all():
                    over = spans(starts[~live], (word_ends - starts)[~live])
                    finished[over] = True
                    spare += len(over)
                    starts, word_ends, best = starts[live], word_ends[live], best[live]
                if 4 * spare >= n:
                    break
                at = best & _INDEX
                right = nxt[at]
                after = nxt[right]
                sym[at], gone[right], key[right], key[at] = into[at], True, _LAST, _LAST
                spare += len(at)
                nxt[at] = after
                has = after >= 0
                left, after = at[has], after[has]
                prv[after] = left
                key[left], into[left] = self._pairs(sym, left, after)
                before = prv[at]
                has = before >= 0
                before, at = before[has], at[has]
                key[before], into[before] = self._pairs(sym, before, at)
            out = finished & ~gone
            done_sym.append(sym[out])
            done_pos.append(pos[out])
            keep = ~(finished | gone)
            sym, pos, word = sym[keep], pos[keep], word[keep]
        if not done_sym:
            return sym, pos
        sym, pos = np.concatenate(done_sym), np.concatenate(done_pos)
        order = np.argsort(pos, kind="stable")
        return sym[order], pos[order]

    def _merge_queue(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one long word, by a queue of (rank, position)."""
        sym = self._symbols(text).tolist()
        table = self.pair_dict
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n and (p := table.get(sym[i] * self.stride + sym[nxt[i]])):
                heapq.heappush(queue, (p[0], i, sym[i], sym[nxt[i]], p[1]))

        for i in range(n):
            push(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            if sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
                continue
            j = nxt[i]
            sym[i], sym[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        at = [i for i in range(n) if sym[i] >= 0]
        return np.array([sym[i] for i in at], np.int64), np.array(at, np.int64)

    def _final(self, merged: tuple[np.ndarray, np.ndarray], text: str):
        return self._final_many(*merged, text, np.zeros(1, np.int64))

    def _final_many(self, sym, pos, text, word_starts) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become their byte pieces."""
        sizes = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym >= self.n_ids)
        coded = [text[p].encode() for p in pos[odd]]
        sizes[odd] = [len(c) for c in coded]
        ids = np.repeat(sym, sizes).astype(np.int32)
        if len(odd):
            starts = (np.cumsum(sizes) - sizes)[odd]
            ids[spans(starts, sizes[odd])] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        edges = np.append(np.searchsorted(pos, word_starts), len(pos))
        return ids, list_sums(sizes, edges)

    # -- decoding ---------------------------------------------------------
    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists given as flat ids and offsets."""
        lens = self.raw_lens[flat]
        data = self.raw[spans(self.raw_starts[flat], lens)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lens)))[offsets]
        mark, out = SPACE.encode(), []
        for k in range(len(offsets) - 1):
            part = data[ends[k]:ends[k + 1]]
            try:
                text = part.decode()
            except UnicodeDecodeError:
                text = self._decode_broken(flat[offsets[k]:offsets[k + 1]])
            out.append((text[1:] if part.startswith(mark) else text).replace(SPACE, " "))
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Byte runs that are no UTF-8 (never from encode): one U+FFFD per bad byte."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.raw[self.raw_starts[i]:self.raw_starts[i] + 1].tobytes()
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            if i >= 0:
                s = self.raw_starts[i]
                out.append(self.raw[s:s + self.raw_lens[i]].tobytes().decode())
        return "".join(out)


_WORKER: dict[bytes, tuple[PieceCodec, SegmentStore]] = {}


def _codec(model: bytes) -> tuple[PieceCodec, SegmentStore]:
    """One codec and word store per Python worker."""
    if model not in _WORKER:
        codec = PieceCodec(model)
        _WORKER[model] = codec, SegmentStore(codec.encode_words)
    return _WORKER[model]


def sentencepiece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                             text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): encode every text, decode the ids.

    Map-only. The model file (its size does not depend on the data) is read on
    the driver and broadcast; every batch is cut into slices of bounded text.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col],
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
                           T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, store = _codec(model.value)
        for batch, texts in text_slices(batches, 1):
            flat, offsets = store.encode([codec.words(t) for t in texts])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(codec.decode(flat, offsets), pa.string())],
                names=[id_col, "ids", "decoded"])

    return map_in_arrow(docs.select(id_col, text_col), run, schema)
