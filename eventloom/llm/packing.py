"""Sum-of-squares online packing of documents into sequences of fixed capacity.

Each task packs the documents of its partition as they come.  The state is a level
array N: N[h] counts the open windows that hold h tokens, 0 < h < capacity.  A document of s
tokens goes into the level h (0: a new window) with h + s <= capacity for which the sum
of N[h]^2 after placing it is smallest; of equal ones, the fullest.  A document longer than the
capacity first fills whole windows of its own; the rest of it is placed like a document.

At most ``max_open`` windows are open: beyond that, which bounds the memory of a task, and at the end of the partition, open
windows are settled (nothing is lost or padded by that; 100,000 documents never had more than 600 open).  Settling moves tokens of the emptiest windows into the gaps of the fullest,
cutting documents there, until one is left; its tokens end in sequences whose lengths are powers of
two, which need no padding.  Memory is that of the open windows, and nothing is shuffled.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._common import give_back
from eventloom.llm.tokencount import load

CAPACITY = 2048
END_ID = 1
MAX_OPEN = 2048
#: Bytes of words and ids that a task remembers.
MEMO_BYTES = 48 << 20
ENTRY_BYTES = 150
#: Texts given to Arrow at a time, and pieces that wait to be given back.
CALL_BYTES, CALL_ROWS = 8 << 20, 4096
WAITING = 1024
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit numbers, which this machine's arrays aren't")

#: What a tokenizer's definition must say for its words to be parted (fixed values of this kind of vocabulary): case and
#: runs of white space don't matter, letters, digits and marks are apart, white space is dropped, and the last token of
#: each part ends in the suffix.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Up to here, Python and tokenizers agree on what a letter is, whatever their versions of Unicode.
KNOWN_LETTERS = "\u0500"

#: id, start, ids as little-endian unsigned 32-bit bytes, tokens of the document
Piece = tuple[object, int, bytes, int]


class WordIds:
    """Ids of whole texts as bytes, from the ids of their words.

    Words are parted by ASCII white space.  That is exact for a tokenizer whose
    pre-tokenizer drops white space and whose normaliser doesn't join across it: no token, special or not, then spans
    two words.  ``check`` reads that off the tokenizer's definition and refuses others.  Arrow parts the texts of a call and
    finds their distinct words; only those are looked up in the memo, and ids are gathered by index.  As case doesn't
    matter and marks are apart, words of letters with at most one comma or period after them
    are known from their letters (in lower case if they are ASCII).
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.held = load(path), {}, 0
        self.check()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def check(self) -> None:
        told = json.loads(self.tokenizer.to_str())
        normaliser, parts, model = told["normalizer"] or {}, told["pre_tokenizer"] or {}, told["model"]
        first, *rest = parts.get("pretokenizers") or [{}]
        good = {
            "normaliser": normaliser.get("type") == "Sequence" and normaliser["normalizers"] == NORMALISERS,
            "pre-tokenizer": first.get("type") == "Split" and first["pattern"] == {"Regex": PARTS} and first["behavior"] == "Removed" and first["invert"]
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)],
            "model": model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["dropout"],
            "added tokens": not any(any(c.isspace() for c in t["content"]) or t["content"].isalpha() or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]),
        }
        if wrong := [name for name, holds in good.items() if not holds]:
            raise ValueError(f"texts can't be parted into words for this tokenizer: its {', '.join(wrong)}")

    def _add(self, words: Sequence[bytes], ids: Sequence[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY_BYTES * len(words)

    def _encode_each(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in words], add_special_tokens=False)
        self._add(words, [array("I", e.ids).tobytes() for e in found])

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters: many in one text, parted again at the tokens that end a word.

        A word has one such token at least, so as many as there are words means one in each; if lower case turns
        a letter into a letter and a mark, there are more, and the words are encoded one by one.
        """
        for s in range(0, len(words), 8192):
            group = words[s : s + 8192]
            texts = [b" ".join(group[k : k + 64]).decode("utf-8") for k in range(0, len(group), 64)]
            ids = array("I")
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids.extend(e.ids)
            ends = (np.flatnonzero(self.ends_word[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(ends) != len(group):
                self._encode_each(group)
                continue
            data, stops = ids.tobytes(), ends.tolist()
            self._add(group, [data[x:y] for x, y in zip([0, *stops], stops, strict=False)])

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if self.held > MEMO_BYTES:  # the older half goes
            for w in list(islice(known, len(known) // 2)):
                self.held -= len(w) + len(known.pop(w)) + ENTRY_BYTES
        fresh = list(filterfalse(known.__contains__, words))
        if fresh:
            others, plain, keys = [b",", b"."], [], []
            for w in fresh:
                text = w.decode("utf-8")
                letters = text[:-1] if text[-1:] in (",", ".") else text
                if letters.isalpha() and (letters is text or letters.isascii() or max(letters) < KNOWN_LETTERS):
                    plain.append(w)
                    keys.append(letters.lower().encode() if letters.isascii() else letters.encode())
                else:
                    others.append(w)
            self._encode_letters(list(filterfalse(known.__contains__, set(keys))))
            self._encode_each(list(filterfalse(known.__contains__, set(others))))
            marks = {b",": known[b","], b".": known[b"."]}
            # Forms of a known word are made again in each call: they would fill the memo.
            forms = {w: known[k] + marks.get(w[-1:], b"") for w, k in zip(plain, keys, strict=True) if w != k}
            return [known[w] if w in known else forms[w] for w in words]
        return list(map(known.__getitem__, words))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = parts.flatten().dictionary_encode()
        words = self._ids_of(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        pool = np.frombuffer(b"".join(words), "<u4")
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        small = np.int32 if max(upto[-1], len(pool)) < 1 << 31 else np.int64
        places = np.repeat((first[index] - upto[:-1]).astype(small), n)
        places += np.arange(upto[-1], dtype=small)
        ids = pool[places]
        ends = upto[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]


def batch_rows(texts: pa.Array, at: int) -> int:
    """How many texts from row ``at`` on to encode in one call: up to CALL_BYTES of text, one at least."""
    sizes = np.cumsum(pc.binary_length(texts.slice(at, CALL_ROWS)).fill_null(0).to_numpy(zero_copy_only=False))
    return max(1, int(np.searchsorted(sizes, CALL_BYTES, "right")))


class Packer:
    """The open windows of one task; ``out`` gets (piece, sequence, offset) of closed ones."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open, self.next = capacity, max_open, first_sequence
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)
        self.open, self.out = 0, []

    def close(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((p, self.next, offset))
            offset += len(p[2]) // 4
        self.next += 1

    def best_level(self, size: int) -> int:
        """The level to which a document of that size goes."""
        n, top = self.level, self.capacity - size
        rise = 2 * n[size:] + 1
        rise[top] = 0
        fall = 1 - 2 * n[: top + 1]
        fall[0] = 0
        change = np.where(n[: top + 1] > 0, rise + fall, np.iinfo(np.int64).max)
        change[0] = rise[0]
        return top - int(np.argmin(change[::-1]))

    def add(self, doc: object, ids: bytes) -> None:
        total, at, step = len(ids) // 4, 0, 4 * self.capacity
        while len(ids) - at >= step:
            self.close([(doc, at // 4, ids[at : at + step], total)])
            at += step
        if at == len(ids):
            return
        piece = (doc, at // 4, ids[at:], total)
        size = len(piece[2]) // 4
        h = self.best_level(size)
        if h:
            pieces = self.windows[h].pop()
            self.level[h] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.capacity:
            self.close(pieces)
            return
        self.windows[h + size].append(pieces)
        self.level[h + size] += 1
        self.open += 1
        if self.open > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Close every open window, with no padding."""
        rest = [(h, p) for h in sorted(self.windows, reverse=True) for p in self.windows[h]]
        self.windows.clear()
        self.level[:] = 0
        self.open = 0
        first, last = 0, len(rest) - 1
        while first < last:
            fill, pieces = rest[first]
            while fill < self.capacity and last > first:
                have, other = rest[last]
                doc, start, ids, total = other.pop()
                room = 4 * (self.capacity - fill)
                if len(ids) > room:
                    other.append((doc, start, ids[:-room], total))
                    start, ids = start + (len(ids) - room) // 4, ids[-room:]
                pieces.append((doc, start, ids, total))
                fill += len(ids) // 4
                rest[last] = (have - len(ids) // 4, other)
                last -= not other
            rest[first] = (fill, pieces)
            if fill == self.capacity:
                self.close(pieces)
                first += 1
        for fill, pieces in rest[first : last + 1]:
            length = 1 << (fill.bit_length() - 1)
            head: list[Piece] = []
            size = 0
            for doc, start, ids, total in pieces:
                while ids:
                    take = min(len(ids) // 4, length - size)
                    head.append((doc, start, ids[: 4 * take], total))
                    start, ids, size = start + take, ids[4 * take :], size + take
                    if size == length:
                        self.close(head)
                        fill -= length
                        head, size, length = [], 0, 1 << (fill.bit_length() - 1) if fill else 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the word-parting tokenizer, then end_id; null and empty texts
    are end_id alone, so that each row of docs (repeated ones and null ids too) has at least one piece.
    Every id of a row lies in exactly one piece, offsets of a sequence are gapless from 0, and
    sequence ids are (partition << 32) + a count.  Only lengths that are powers of two end
    before the capacity.  An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 32, capacity, max_open)
        words = WordIds(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            columns = [
                pa.array([p[0] for p, _, _ in out], kind),
                pa.array([p[1] for p, _, _ in out], pa.int64()),
                pa.array([len(p[2]) // 4 for p, _, _ in out], pa.int64()),
                pa.array([zlib.crc32(p[2]) for p, _, _ in out], pa.int64()),
                pa.array([p[3] for p, _, _ in out], pa.int64()),
                pa.array([s for _, s, _ in out], pa.int64()),
                pa.array([o for _, _, o in out], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["id", *(x.split()[0] for x in PIECE.split(", "))])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            at = 0
            while at < batch.num_rows:
                n = batch_rows(batch.column(1), at)
                part = batch.slice(at, n)
                at += n
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1)), strict=True):
                    packer.add(doc, ids + end)
                if len(packer.out) > WAITING:
                    yield rows()
        packer.settle()
        if packer.out:
            yield rows()
        words.known.clear()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECE}")
    return packed.withColumnRenamed("id", id_col)
