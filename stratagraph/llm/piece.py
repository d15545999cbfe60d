"""Exact encoding with a merge-type sentencepiece model by backtracking, and decoding.

An Aho-Corasick automaton of the model's pieces finds every piece at every position of a segment. The
encoder takes the longest piece, goes on where it ends, and goes back to a shorter one where two
neighbours aren't compatible: two pieces may stand side by side only if merging their joined characters
anew, best score first, gives just these two. A sequence whose neighbours are all compatible is the only
one and is what the merges give. Each prefix has but one such sequence, so a position that fails once
always fails; a bitfield keeps these positions.

Text is cut into segments where no piece can cross: before a blank after another character (no piece
has a blank inside), and at line feeds if no piece holds one. Segments are kept in a bounded memo.

Null and empty texts have only the end id and decode to an empty text. Repeated rows are encoded each
for itself; very long texts go whole through the same path, segment by segment. There are no ties: of equal scores the
leftmost pair merges first. Columns but the key and the text, whatever their names, aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Segments in each half of a worker's memo, and pairs whose compatibility is kept.
MEMO, PAIRS = 120_000, 300_000
#: Longer segments aren't kept in the memo.
MEMO_CHARS = 48
_CODECS: dict[str, PieceCodec] = {}


class _Memo(dict):
    """A segment's ids by the segment without the prefix. When it is full it becomes the older half, from which what is used comes back."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix, self.older = encode, prefix, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.older.get(key)
        if ids is None:
            ids = tuple(self.encode(self.prefix + key))
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class PieceCodec:
    """encode() and decode() of one model; the library serves for the vocabulary and for decoding."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        skip = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces with a blank inside aren't supported")
        self.by_line = not any("\n" in p for p in self.ids)
        self.newline = tuple(self._unknown("\n"))
        self.segments = re.compile(rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if self.by_line else rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.inner, self.spaced = _Memo(self._segment, ""), _Memo(self._segment, BLANK)

    def merged(self, text: str) -> list[str]:
        """Merges neighbours into pieces, the best score first, the leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _alone(self, piece: int) -> bool:
        if (ok := self.whole.get(piece)) is None:
            ok = self.whole[piece] = len(self.merged(self.text[piece])) == 1
        return ok

    def _compatible(self, left: int, right: int) -> bool:
        ok = self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def _unknown(self, char: str) -> list[int]:
        if min(self.bytes) >= 0 and self.library.is_byte(self.bytes[0]):
            return [self.bytes[b] for b in char.encode("utf-8")]
        return [self.library.unk_id()]

    def _segment(self, text: str) -> list[int]:
        """A segment may hold characters that no piece has; nothing merges across them."""
        if self.chars.issuperset(text):
            return self._known(text)
        out, run = [], 0
        for i, char in enumerate(text):
            if char not in self.chars:
                if run < i:
                    out += self._known(text[run:i])
                out += self._unknown(char)
                run = i + 1
        return out + (self._known(text[run:]) if run < len(text) else [])

    def _known(self, text: str) -> list[int]:
        size = len(text)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, found in self.automaton.iter(text):
            starting[last + 1 - found[1]].append(found)  # shorter ones come first
        failed = bytearray(size + 1)
        out: list[int] = []
        path: list[tuple[int, int]] = []  # position and place in its list, for each piece of out
        at, place = 0, len(starting[0]) - 1
        pairs, alone = self.pairs, self.whole
        while at < size:
            here = starting[at]
            before = out[-1] if out else -1
            while place >= 0:
                piece, length = here[place]
                if not failed[at + length]:
                    if before >= 0:
                        ok = pairs.get((before, piece))
                        if ok is None:
                            ok = self._compatible(before, piece)
                    else:
                        ok = alone.get(piece)
                        if ok is None:
                            ok = self._alone(piece)
                    if ok:
                        break
                place -= 1
            if place >= 0:
                out.append(piece)
                path.append((at, place))
                at += length
                place = len(starting[at]) - 1 if at < size else 0
            elif out:
                failed[at] = 1
                out.pop()
                at, place = path.pop()
                place -= 1
            else:
                raise AssertionError("no sequence of pieces for a segment of known characters")
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids with the end id."""
        if not text:
            return [self.end]
        found: list[tuple[int, ...]] = []
        for i, line in enumerate(text.split("\n") if self.by_line else [text]):
            if i:
                found.append(self.newline)
            if "  " in line or BLANK in line or line[:1] == " " and not i or line[-1:] == " ":
                marked = (BLANK if not i else "") + line.replace(" ", BLANK)
                found += [self.inner[x] for x in self.segments.findall(marked)]
                continue
            words = line.split(" ")
            if i:
                if words[0]:
                    found.append(self.inner[words[0]])
                del words[0]
            elif not line:
                found.append(self.spaced[""])
                continue
            spaced = self.spaced
            found += [spaced[w] for w in words]
        out = list(chain.from_iterable(found))
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> PieceCodec:
    """One codec a worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: every row's ids with the end id. One narrow pass."""
    path = path or public_tokenizers.path(MODEL)

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(path)
        return {"key": batch.column(0), "ids": [coder.encode(t) for t in batch.column(1).to_pylist()]}

    kind = docs.schema[key].dataType.simpleString()
    out = by_batch(docs.select(F.col(key).alias("key"), F.col(text).cast("string")), run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, decoded_equal: ids, decoded again, in the same pass."""
    path = path or public_tokenizers.path(MODEL)

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(path)
        names = [str(i) for i in range(coder.library.get_piece_size())]
        out = {"key": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "decoded_equal": []}
        for value in batch.column(1):
            value = value.as_py()
            ids = coder.encode(value)
            back = coder.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["decoded_equal"].append(back == (value or ""))
        return out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_equal boolean"
    return by_batch(docs.select(F.col(key).alias("key"), F.col(text).cast("string")), run, schema).withColumnRenamed("key", key)
