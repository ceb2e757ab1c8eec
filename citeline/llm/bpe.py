"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

Method. A token sequence is the BPE encoding of its bytes exactly when every token encodes to
itself and every adjacent pair does too. So each prefix of a word has one encoding, found left to
right: the last token of a prefix is the vocabulary entry that ends there and is compatible with the
last token of the shorter prefix. A token of any longer input starts at most ``lookahead`` bytes
back, where ``lookahead`` is the byte length of the longest merge result. Whatever all encodings
of the prefixes within that window share is stable: it is emitted and forgotten, so memory does not
follow the length of a word. A text goes through in portions, cut where a word begins in any case, and digests are
fed portion by portion. Decoding feeds token bytes to an incremental UTF-8 state machine that holds
back at most three bytes.

Defined cases: null and empty texts have no tokens and decode to the empty text; strings of added
tokens inside a text become the added token, as the library does; merges of equal rank (ties) go leftmost
first; very long texts take time in proportion to their length; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import small_batches

#: The split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers before it starts anew, and how long they may be.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 80
#: Characters of a text that are encoded at once; where a text may be cut: before a single space between two other
#: characters, which begins a word in any case.
PORTION = 1 << 16
CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Transducer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        text = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: text(t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(text(a), text(b)): n for n, (a, b) in enumerate(pairs)}
        merges = [(self.id_of.get(a), self.id_of.get(b), self.id_of.get(a + b)) for a, b in self.rank]
        self.joins = {a << 32 | b: n for (a, b, _), n in zip(merges, self.rank.values()) if a is not None and b is not None}  # rank by left id << 32 | right id
        self.parts = {i: (a, b) for a, b, i in merges}  # of a token that a merge makes
        self.made = {i: n for (_, _, i), n in zip(merges, self.rank.values())}
        self.plain_merges = len(self.parts) == len(merges) and all(None not in m for m in merges)
        self.lookahead = max((len(a) + len(b) for a, b in self.rank), default=1)
        self.spans: dict[bytes, int] = {}  # by three bytes: the longest token that ends in them
        for b in self.id_of:
            if len(b) > 2:
                self.spans[b[-3:]] = max(len(b), self.spans.get(b[-3:], 0))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split = regex.compile(SPLIT)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.own = bytearray(1 + max(self.bytes_of))  # by id: 1 encodes to itself, 2 does not, 0 not yet known
        self.fits: dict[int, bool] = {}  # by left id << 32 | right id
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a short byte string straight from the merge list: lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def proper(self, i: int) -> bool:
        """Whether a token encodes to itself."""
        if not self.own[i]:
            self.own[i] = 1 if self.merged(self.bytes_of[i]) == [self.bytes_of[i]] else 2
        return self.own[i] == 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other stay as they are."""
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            if self.plain_merges:
                known = self.apart(left, right)
            else:
                a, b = self.bytes_of[left], self.bytes_of[right]
                known = (a, b) not in self.rank and self.merged(a + b) == [a, b]
            self.fits[left << 32 | right] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """The same for tokens that encode to themselves, where one merge makes each token: merges are undone at the seam, the latest first.

        What stands at the seam then would have merged across it if that merge came before the one undone; of equal ranks the left one comes first.
        """
        joins, made, parts = self.joins.get, self.made.get, self.parts
        a, b, before = made(left, -1), made(right, -1), 1 << 60
        while joins(left << 32 | right, before) >= before:
            if a > b:
                before, left = a, parts[left][1]
                a = made(left, -1)
            elif b < 0:
                return True
            else:
                before, right = b + 1, parts[right][0]
                b = made(right, -1)
        return False

    def extend(self, buffer: bytes, last: list[int]) -> None:
        """Find the last token of each further prefix of ``buffer``; -1 stands before its start."""
        found, own, fits, spans = self.id_of.get, self.own, self.fits.get, self.spans.get
        for end in range(len(last), len(buffer) + 1):
            longest = spans(buffer[end - 3 : end], 2) if end > 2 else end
            for at in range(end - longest if end > longest else 0, end):
                i = found(buffer[at:end])
                if i is not None and (own[i] == 1 or self.proper(i)):
                    left = last[at]
                    if left < 0:
                        break
                    fit = fits(left << 32 | i)
                    if self.compatible(left, i) if fit is None else fit:
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(i)

    def back(self, last: list[int], end: int) -> list[int]:
        """The tokens of the prefix of ``end`` bytes."""
        out, size = [], self.size
        while end:
            i = last[end]
            out.append(i)
            end -= size[i]
        return out[::-1]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one word that arrives in chunks; keeps a few windows of bytes at most."""
        buffer, last, longest = b"", [-1], self.lookahead
        for chunk in chunks:
            for at in range(0, len(chunk), 4 * longest):
                buffer += chunk[at : at + 4 * longest]
                self.extend(buffer, last)
                if len(buffer) > 4 * longest:
                    stable = self.shared(last)
                    yield from self.back(last, stable)
                    if stable:
                        buffer, last = buffer[stable:], last[stable:]
        yield from self.back(last, len(buffer))

    def shared(self, last: list[int]) -> int:
        """Where the encodings of all prefixes in the window last agree; what ends there is stable."""
        ends = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.size[last[far]])
        return ends.pop()

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-split word; the words of two generations are remembered."""
        found = self.older.get(text)
        if found is None:
            data = text.encode()
            if len(data) <= 4 * self.lookahead:
                last = [-1]
                self.extend(data, last)
                found = tuple(self.back(last, len(data)))
            else:
                found = tuple(self.stream((data,)))
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
            self.words[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        if not text:
            return []
        if self.split_added and any(a in text for a in self.added):
            return [i for part in self.split_added.split(text) if part for i in ([self.added[part]] if part in self.added else self.plain(part))]
        return self.plain(text)

    def portions(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text in lists of bounded size, whatever its length; only a stretch without a single space is one piece."""
        text, at = text or "", 0
        while at < len(text):
            end = len(text)
            if end - at > PORTION and (found := CUT.search(text, at + PORTION)):
                end = found.start()
            piece = text[at:end]
            if self.split_added and end < len(text) and any(a in text[max(0, end - len(a)) : end + len(a)] for a in self.added):
                piece, end = text[at:], len(text)  # an added token may stand across the cut
            yield self.encode(piece)
            at = end

    def plain(self, text: str) -> list[int]:
        found = self.words.get  # a generation that ends meanwhile stays readable here
        return list(chain.from_iterable([found(w) or self.word(w) for w in self.split.findall(text)]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return "".join(self.decoded([ids]))

    def decoded(self, portions: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of portions of ids, piece by piece; a character whose bytes are not all there waits in the machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in portions:
            data = map(self.bytes_of.__getitem__, ids)
            while piece := b"".join(x for _, x in zip(range(4096), data)):
                yield machine.decode(piece)
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows with the token ids of ``text`` as array<int>; the vocabulary is read where the rows are."""

    @F.pandas_udf("array<int>")
    def run(texts):
        return texts.map(transducer(path).encode)

    small_batches(df.sparkSession)
    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows with the text of ``ids``; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def run(rows):
        return rows.map(lambda x: transducer(path).decode([] if x is None else x))

    small_batches(df.sparkSession)
    return df.withColumn(text, run(F.col(ids)))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text and return digests of both, without moving ids between processes."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        t = transducer(path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                of_ids, of_text, many = hashlib.sha256(), hashlib.sha256(), 0

                def digested(portions):
                    nonlocal many
                    for ids in portions:
                        if ids:
                            of_ids.update((("," if many else "") + ",".join(map(t.decimal.__getitem__, ids))).encode())
                            many += len(ids)
                        yield ids

                for piece in t.decoded(digested(t.portions(value.as_py()))):
                    of_text.update(piece.encode("utf-8", "replace"))
                counts.append(many)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
