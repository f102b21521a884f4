"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Spaces become marks and every text gets one in front; a marked word is a run of
marks with what follows, and no piece reaches over the next mark, so words are
encoded apart.  A task sorts its distinct unseen words, which is the depth-first order
of their trie, and keeps the forward states of the path: for every prefix of the word
the best last piece and where it starts.  A word only computes the states beyond the
prefix it shares with the one before it, and is read off backwards.

The public model is a byte-pair model, whose best path isn't the one of the largest
score sum but the one its merges produce.  The forward state of a prefix is therefore
a feasible one: a last piece may follow the best path of the prefix before it exactly
if the two pieces, put together, encode to themselves.  One piece survives per
prefix, so the state is as small as a Viterbi score, and the ids are the library's.
That check is remembered per pair of pieces.  An automaton over the vocabulary (Aho and
Corasick) reads the word letter by letter and names the pieces that end at a prefix,
longest first, so no other span is looked at.  Characters without a piece become their
UTF-8 bytes' pieces.

Decoding puts the pieces' bytes end to end and drops the mark in front.

Defined results: null text gives null ids and null text; empty text gives no ids; the
mark character itself decodes to a space; repeated rows are encoded each; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import process_cache, row_chunks, span_hashes, text_bytes
from ledgerline.llm.tokens import WordTable, vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Pairs of pieces whose check a worker remembers before it starts anew.
MAX_PAIRS = 2_000_000
#: Steps of the automaton beyond the vocabulary's own that a worker remembers.
MAX_STEPS = 500_000


class Pieces:
    """The vocabulary, and which pieces may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.byte_ids = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.unknown = model.unk_id()
        self.none = len(self.bytes)  # stands before the first piece; characters without a piece come after it
        self.width = self.none + 1 + 0x110000
        self.names = {i: piece for piece, i in self.ids.items()} | {self.none: ""}
        self.pairs: dict = {}
        self._automaton()

    def _automaton(self) -> None:
        """Per state, its steps by letter, the state to fall back to, and the pieces (length, id) that end there."""
        self.steps, self.back, self.ends, depth, above = [{}], [0], [()], [0], [(0, "")]
        for piece in self.ids:
            at = 0
            for c in piece:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.back.append(0)
                    self.ends.append(())
                    depth.append(depth[at] + 1)
                    above.append((at, c))
                at = to
            self.ends[at] = ((len(piece), self.ids[piece]),)
        for at in sorted(range(1, len(depth)), key=depth.__getitem__):
            top, c = above[at]
            if top:
                top = self.back[top]
                while top and c not in self.steps[top]:
                    top = self.back[top]
                self.back[at] = self.steps[top].get(c, 0)
            self.ends[at] += self.ends[self.back[at]]
        self.taken = 0

    def step(self, at: int, c: str) -> int:
        """The state after a letter that `at` has no step for, by way of the states to fall back to."""
        to = at
        while to and c not in self.steps[to]:
            to = self.back[to]
        to = self.steps[to].get(c, 0)
        if self.taken < MAX_STEPS:
            self.steps[at][c] = to
            self.taken += 1
        return to

    def merge(self, symbols: list) -> list:
        """Join the neighbours of the best piece, leftmost first, until none is left."""
        scores, none = self.scores, -np.inf
        gains = [scores.get(a + b, none) for a, b in pairwise(symbols)]
        while gains and (best := max(gains)) > none:
            k = gains.index(best)
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = scores.get(symbols[k - 1] + symbols[k], none)
            if k < len(gains):
                gains[k] = scores.get(symbols[k] + symbols[k + 1], none)
        return symbols

    def name(self, piece: int) -> str:
        return self.names.get(piece) if piece <= self.none else chr(piece - self.none - 1)

    def stands(self, left: int, right: int) -> bool:
        """Whether `left` and `right` encode to themselves when put together (`none` for no piece)."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        names = [self.name(left), self.name(right)]
        found = self.merge(list("".join(names))) == [p for p in names if p]
        self.pairs[left * self.width + right] = found
        return found

    def spell(self, piece: int) -> list:
        if piece < self.none:
            return [piece]
        return [self.byte_ids.get(b, self.unknown) for b in self.name(piece).encode()]

    def encode(self, words: list) -> list:
        """Ids of every word; words share the states of common prefixes."""
        marked = [w.replace(" ", MARK) for w in words]
        out: list = [None] * len(words)
        # per prefix: its last piece, where that starts, and the automaton's state
        last, first, state, before = [self.none], [0], [0], ""
        steps, ends, pairs, width, none = self.steps, self.ends, self.pairs, self.width, self.none
        for n in sorted(range(len(words)), key=marked.__getitem__):
            word = marked[n]
            k, end = 0, min(len(word), len(before), len(last) - 1)
            while k < end and word[k] == before[k]:
                k += 1
            del last[k + 1:], first[k + 1:], state[k + 1:]
            at, i = state[k], k
            for c in word[k:]:
                i += 1
                to = steps[at].get(c)
                at = self.step(at, c) if to is None else to
                for size, piece in ends[at]:
                    s = i - size
                    ok = pairs.get(last[s] * width + piece)
                    if ok or ok is None and self.stands(last[s], piece):
                        break
                else:
                    s, piece = i - 1, none + 1 + ord(c)
                    if not (pairs.get(last[s] * width + piece) or self.stands(last[s], piece)):
                        raise ValueError("no path")
                last.append(piece)
                first.append(s)
                state.append(at)
            before, found, i = word, [], len(word)
            while i:
                found.append(last[i])
                i = first[i]
            found.reverse()
            out[n] = found if not found or max(found) < none else [x for p in found for x in self.spell(p)]
        return out


def pieces(path: str) -> Pieces:
    store = process_cache("sentence-pieces")
    if ("pieces", path) not in store:
        store["pieces", path] = Pieces(path)
    return store["pieces", path]


def _table(path: str) -> WordTable:
    store = process_cache("sentence-pieces")
    if ("piece words", path) not in store:
        store["piece words", path] = WordTable(pieces(path).encode)
    return store["piece words", path]


def _marked(raw: np.ndarray, at: np.ndarray):
    """Bytes with a space before every non-empty row, its offsets, and the marked words' spans and rows."""
    sign = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else raw[:0]
    if len(sign):  # the mark itself is a space
        raw = raw.copy()
        raw[sign] = 32
        keep = np.ones(len(raw), bool)
        keep[sign + 1] = keep[sign + 2] = False
        shift = np.concatenate([[0], np.cumsum(~keep)])
        raw, at = raw[keep], at - shift[at]
    full = np.flatnonzero(np.diff(at))
    buf = np.insert(raw, at[full], 32)
    off = at + np.searchsorted(full, np.arange(len(at)), "left")
    space = buf == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[full]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(buf))[:len(starts)]
    return buf, starts, ends, np.searchsorted(off, starts, "right") - 1


def encode_column(column, table: WordTable):
    """Yield (first row, ids, n+1 offsets) for runs of rows."""
    buf, off = text_bytes(column)
    for i, j in row_chunks(off):
        marked, starts, ends, rows = _marked(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        flat, sizes = table.ids(marked, starts, ends, span_hashes(marked, starts, ends) | np.uint64(1))
        per_row = np.bincount(rows, sizes, j - i).astype(np.int64)
        yield i, flat, np.concatenate([[0], np.cumsum(per_row)])


def _encode(path: str, at: int):
    def run(batches):
        import pyarrow as pa

        table = _table(path)
        for batch in batches:
            null = batch.column(at).is_null()
            for i, flat, ends in encode_column(batch.column(at), table):
                part = batch.slice(i, len(ends) - 1)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)),
                                               mask=null.slice(i, len(ends) - 1))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])
    return run


def _decode(path: str, at: int):
    def run(batches):
        import pyarrow as pa

        known = pieces(path).bytes
        size = np.array([len(b) for b in known], np.int64)
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(known), np.uint8)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                lists = part.column(at)
                counts = np.array(lists.value_lengths().fill_null(0))
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = size[ids]
                ends = np.cumsum(sizes)
                flat = pool[np.repeat(first[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
                cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                raw = flat.tobytes()
                texts = [None if not ok else raw[a + (raw[a:a + 1] == b" "):b].decode("utf-8", "replace")
                         for a, b, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, "decoded"])
    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(df: DataFrame, column: str = "text", model: str | None = None) -> DataFrame:
    """`df` with the ids of a text column as `ids array<int>`."""
    return df.mapInArrow(_encode(model or vocabulary(MODEL), df.columns.index(column)), _fields(df) + ", ids array<int>")


def decode(df: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """`df` with the text of an id column as `decoded string`."""
    return df.mapInArrow(_decode(model or vocabulary(MODEL), df.columns.index(column)), _fields(df) + ", decoded string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_chars and crc32 of the decoded text, and whether it is the text again."""
    both = decode(encode(docs.select("doc_id", "text")))
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("n_chars"),
                       F.crc32("decoded").alias("decoded_crc32"),
                       F.col("decoded").eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" "))).alias("lossless"))
