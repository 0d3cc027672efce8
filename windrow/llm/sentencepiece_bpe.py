"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

The merges of BPE need not be replayed. Every prefix of a text has one encoding, so one last token, and
a token t ends the encoding of a prefix exactly if the prefix before it ends in a token that may stand left of t.
An Aho-Corasick automaton names the tokens that end at each position, a memoised test says whether two tokens are
compatible (their concatenation is encoded as just these two), and the ids are recovered backwards from the end.

Texts are first cut where no token of the vocabulary joins the two characters, which changes nothing; the pieces
between cuts repeat a lot, and a bounded table keeps the pieces already encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import lean

#: The library's mark for a space, and the rank beyond all tokens.
MARK, NEVER = "▁", 1 << 60
#: Pieces and tested pairs kept per Python worker; a table is emptied when it is full, which costs time and changes nothing.
MOST_KEPT, LONGEST_KEPT, MOST_PAIRS = 250_000, 64, 200_000


class PrefixTable:
    """The vocabulary of a SentencePiece BPE model with byte fallback, its pair test and its automaton."""

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.unknown = model.unk_id()
        if not all(map(model.is_byte, self.byte_id)):
            raise ValueError("the model has no byte fallback")
        # Runs of spaces share one score below all others: they merge last and leftmost first, on their own.
        self.run = {len(p): i for i, p in self.piece.items() if set(p) == {MARK}}
        long_runs = {i for n, i in self.run.items() if n > 1}
        others = [i for i in plain if i not in long_runs]
        scores = sorted(((model.get_score(i), i) for i in others if len(self.piece[i]) > 1), reverse=True)
        if len({s for s, _ in scores}) != len(scores) or long_runs and scores and max(map(model.get_score, long_runs)) >= scores[-1][0]:
            raise ValueError("the model is not a merge vocabulary with distinct scores")
        if any(MARK * 2 in self.piece[i] for i in others):
            raise ValueError("the model has tokens that hold a run of spaces and more")
        rank = {self.piece[i]: n for n, (_, i) in enumerate(scores)}
        self.single = {p: i for i in others if len(p := self.piece[i]) == 1}
        self.singles = frozenset(self.single)
        self.rank = rank
        self.id_of = {self.piece[i]: i for i in others}
        self.spines(rank)
        self.automaton = ahocorasick.Automaton()
        for p in [*self.single, *self.left]:
            self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()
        pairs = {(a, b) for p in self.left for a, b in zip(p, p[1:])} | {(MARK, MARK)}
        inside = sorted({c for pair in pairs for c in pair})
        self.column = np.zeros(0x110000, np.uint16)
        self.column[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joins = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        self.joins[[self.column[ord(a)] for a, _ in pairs], [self.column[ord(b)] for _, b in pairs]] = True
        self.fits: dict[int, bool] = {}
        self.kept = _Kept(self)

    def spines(self, rank: dict[str, int]) -> None:
        """For each token that encoding its own text yields: its right and left spines, from the character up.

        left[p] and right[p] list (text, rank at which the next larger part of the spine is made)."""
        halves: dict[str, tuple[str, str]] = {}
        for p in sorted(rank, key=rank.__getitem__):
            parts = list(p)
            while len(parts) > 2:
                best, at = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if best >= rank[p]:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(len(x) > 1 or x in self.single for x in parts):
                halves[p] = (parts[0], parts[1])
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.right: dict[str, list[tuple[str, int]]] = {}
        for out, side in ((self.left, 0), (self.right, 1)):
            for p in halves:
                spine, x, made = [], p, NEVER
                while x is not None:
                    spine.append((x, made))
                    made, x = rank.get(x, NEVER), halves[x][side] if x in halves else None
                out[p] = spine[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the concatenated texts of tokens a and b are encoded as a, b.

        Along the border, the parts of a's right spine and b's left spine grow by their ranks; a and b stay apart
        unless some two parts meet that merge before either of them grows. Of equal ranks the left one goes first.
        """
        pair = a << 20 | b
        known = self.fits.get(pair)
        if known is not None:
            return known
        x, y = self.piece[a], self.piece[b]
        ends, begins = self.right.get(x) or [(x, NEVER)], self.left.get(y) or [(y, NEVER)]
        i = j = 0
        fits = True
        while True:
            (s, grow_s), (u, grow_u) = ends[i], begins[j]
            met = self.rank.get(s + u, NEVER)
            if met < grow_s and met <= grow_u:
                fits = False
                break
            if grow_s == NEVER and grow_u == NEVER:
                break
            if grow_s <= grow_u:
                i += 1
            else:
                j += 1
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def _known(self, text: str) -> list[int]:
        """The ids of a text without unknown characters, runs of spaces as single ones.

        The automaton names the tokens that end at a position one after the other; the first that is compatible with
        the last token of the prefix before it is the last token there, and no other is.
        """
        last, done = [-1] * len(text), -1
        compatible, known = self.compatible, self.fits.get
        for end, (token, size) in self.automaton.iter(text):
            if end == done:
                continue
            if size <= end:
                before = last[end - size]
                fits = known(before << 20 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            last[end] = token
            done = end
        if -1 in last:
            raise AssertionError("a prefix without an encoding")
        out, at, piece = [], len(text) - 1, self.piece
        while at >= 0:
            out.append(token := last[at])
            at -= len(piece[token])
        out.reverse()
        return out

    def _spaces(self, count: int) -> list[int]:
        """How the library merges so many single spaces: the leftmost pair that makes a token, again and again."""
        done: list[int] = []
        rest, now = count - 1, 1
        while True:
            if done and done[-1] + now in self.run:
                now += done.pop()
            elif rest and now + 1 in self.run:
                now, rest = now + 1, rest - 1
            else:
                done.append(now)
                if not rest:
                    return [self.run[n] for n in done]
                rest, now = rest - 1, 1

    def encode_piece(self, text: str) -> list[int]:
        """The ids of a normalised text (spaces as marks, one of them in front)."""
        out: list[int] = []
        begin = 0
        if not self.singles.issuperset(text):
            for k, c in enumerate(text):
                if c not in self.single:
                    if k > begin:
                        out += self._known(text[begin:k])
                    out += [self.byte_id[b] for b in c.encode()]
                    begin = k + 1
        if begin < len(text):
            out += self._known(text[begin:] if begin else text)
        if MARK * 2 in text:
            one, merged, n = self.run[1], [], 0
            for i in [*out, -1]:
                if i == one:
                    n += 1
                    continue
                merged += self._spaces(n) if n else []
                n = 0
                merged.append(i)
            out = merged[:-1]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library gives it, without the space that encoding put in front."""
        text = self.decode_piece(ids).replace(MARK, " ")
        return text[1:] if ids and ids[0] in self.piece and text[:1] == " " else text

    def decode_piece(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_bytes_text(held))
                held = bytearray()
            out.append(self.piece.get(i, "" if i != self.unknown else f" {chr(0x2047)} "))
        if held:
            out.append(_bytes_text(held))
        return "".join(out)

    def pieces(self, text: str) -> list[str]:
        """The normalised text, cut where no token can join what is left and right of the cut."""
        whole = MARK + text.replace(" ", MARK)
        column = self.column[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.joins[column[:-1], column[1:]]) + 1).tolist()
        return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for p in self.pieces(text) for i in self.encode_piece(p)]

    def summary(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, the ids joined by commas, the text decoded from them); null counts as empty.

        A piece is decoded from its ids when it is met first. All pieces but odd ones decode to themselves, so the
        text decodes to itself unless it has an odd piece; then its ids are decoded one by one.
        """
        if not text:
            return 0, "", ""
        pieces, odd = self.pieces(text), self.kept.odd
        ids = ",".join(map(self.kept.__getitem__, pieces))
        # Only texts with an odd piece are decoded id by id, here and in texts to come.
        if self.kept.met or odd and not odd.isdisjoint(pieces):
            self.kept.met = False
            return ids.count(",") + 1, ids, self.decode([int(i) for i in ids.split(",")])
        return ids.count(",") + 1, ids, "".join(pieces)[1:].replace(MARK, " ")


class _Kept(dict):
    """Pieces and their ids as text; bounded in number and in the length of a piece.

    ``odd`` holds the kept pieces whose ids decode to another text, and ``met`` tells whether one was encoded just now."""

    def __init__(self, table: PrefixTable):
        self.table, self.odd, self.met = table, set(), False

    def __missing__(self, piece: str) -> str:
        ids = self.table.encode_piece(piece)
        # Plain tokens spell the piece that they cover, so only bytes can decode to something else.
        odd = not self.table.byte_of.keys().isdisjoint(ids) and self.table.decode_piece(ids) != piece
        self.met |= odd
        out = ",".join(map(str, ids))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                # What is still to come of the text may hold a piece that is known to be odd, so those stay known.
                self.clear()
            self[piece] = out
            if odd and len(self.odd) < MOST_KEPT:
                self.odd.add(piece)
            elif odd:
                del self[piece]  # it will be met again each time
        return out


def _bytes_text(held: bytearray) -> str:
    """Bytes as text; each byte that is not part of a valid character is a replacement character."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for n in (4, 3, 2, 1):
                try:
                    out.append(bytes(held[at : at + n]).decode())
                    at += min(n, len(held) - at)
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def prefix_table(proto: bytes) -> PrefixTable:
    """One table per model and Python process."""
    return PrefixTable(proto)


def model_bytes(path: str) -> bytes:
    """The model, read on the driver: it goes to the executors with the tasks, which need not have the file."""
    with open(path, "rb") as source:
        return source.read()


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``; a null or empty text has no ids."""
    proto = model_bytes(model_path)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(proto)
        for batch in batches:
            ids = pa.array([table.encode(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(part), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    proto = model_bytes(model_path)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(proto)
        for batch in batches:
            text = pa.array([table.decode(i.as_py() or []) for i in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(part), "doc_id long, text string")


def tokenised(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, over the whole text.

    Null and empty texts have no ids; their digests are those of the empty string. Repeated rows are encoded each;
    columns other than doc_id and text are not read; a table without rows gives none. A Python worker holds one batch
    of texts, one text's ids and the bounded table of pieces.
    """
    proto = model_bytes(model_path)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(proto)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                n, ids, decoded = table.summary(text.as_py())
                found.append((n, digest(ids), digest(decoded)))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(part), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
