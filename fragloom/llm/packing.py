r"""Best-fit packing with exact-complement hashing.

Documents become token ids (a byte-level BPE file, then END); those longer than `limit` are cut into pieces of `limit`
ids, the first piece takes the rest. How pieces share sequences depends on their lengths alone, so the plan is made for
the histogram of lengths, at most `limit` counts: for the longest length left, the gap is looked up among the sums of
single, pairs and triples of available lengths, and what fills it exactly is consumed as often as the counts allow. Where
nothing fills it, the longest length that fits goes in and the smaller gap is looked up again (best fit). Each step uses
up a length, or all but one of it, so a plan has a few thousand patterns at any size of input.

Pieces then find their place by their rank among the pieces of their length: counts a (length, bucket) are summed up to
offsets, ranks are counted within them, and a rank falls into one pattern's range.

Scale: texts are read and tokenised once, in Python workers; afterwards rows of a few numbers are shuffled, dealt by
length and a hash to buckets of about BUCKET, so a length that holds a third of all pieces has many tasks. The driver sees
`limit` counts and keeps an index of at most 2 * limit ** 2 lengths.

Tokenising: pieces of text between which the BPE never merges are cut at blanks, line ends, commas and stops in plain
prose and found by the public pattern in other texts, and their ids cached as bytes; the BPE model of the tokenizers
library encodes each new one. Texts with characters for which the pattern and the library were not seen to agree go to
the library whole, as texts do that hold the string of an added token, which the library makes one id of.

Defined cases: null text is empty and packs as END alone. Repeated rows are packed one by one. Other columns of the input,
whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm._shared import stored, table, with_row_id

LIMIT = 2048
END = b"\0\0\0\0"
#: Cached ids of pieces of text in a worker, and pieces in a ranking bucket, about.
CACHE, BUCKET = 1_500_000, 500
#: Code points checked for agreement between the pattern and the library.
CHECKED = 0x250

_PIECES = "_rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


#: Byte to character of byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = chr(_ALPHABET[32])


class Encoder:
    """Text to the little-endian 32-bit ids of a byte-level BPE tokenizer file, as bytes."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for tokens of their own: texts with one go to it whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.find = regex.compile(pattern).findall
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        odd = []
        for c in map(chr, range(1, CHECKED)):
            probe = f"a{c}1{c}{c} {c}a {c} 1"
            if [b - a for _, (a, b) in split(probe)] != [len(x) for x in self.find(probe)]:
                odd.append(re.escape(c))
        self.unsafe = re.compile(f"[\0{''.join(odd)}{chr(CHECKED)}-\U0010ffff]").search
        # Without white space, which _plain() sees to, all of Latin-1 is safe if only this is not in it.
        self.odd_latin = "".join(c[-1] for c in odd if ord(c[-1]) < 256 and not c[-1].isspace()) + "\0"
        self.cache: dict[str, bytes] = {"": b""}

    def _word(self, piece: str) -> bytes:
        """Ids of a pre-token, or of a few in a row, by the library's BPE model; its alphabet is one character a byte."""
        if piece.isalpha() or piece[1:].isalpha():
            if piece.isascii():
                shown = _BLANK + piece[1:] if piece[0] == " " else piece
                if shown.isalpha():
                    return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            parts = [piece]
        else:
            parts = self.find(piece)
        return array("I", [t.id for p in parts for t in self.model.tokenize(p.encode().decode("latin-1").translate(_ALPHABET))]).tobytes()

    def _known(self, pieces: list[str]) -> bytes:
        if new := list(set(pieces).difference(self.cache)):
            if len(self.cache) > CACHE:
                self.cache.clear()
                new = list(set(pieces))
            self.cache.update(zip(new, map(self._word, new)))
        return b"".join(map(self.cache.__getitem__, pieces))

    def _plain(self, text: str) -> bool:
        """All white space is single blanks and line ends between other characters, and those are safe."""
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.unsafe(text)
        return not any(c in text for c in self.odd_latin)

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self._plain(text) and _prose(text):
            # Words with the blank before them, line ends, commas and stops: what the pattern finds, cut without it.
            return self._known(text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0"))
        if self.unsafe(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._known(self.find(text))


def _prose(text: str) -> bool:
    """All characters but white space are letters and digits, or commas and stops at the ends of words."""
    ends = sum(text.count(p + s) for p in ",." for s in " \n") + text.endswith((",", "."))
    if ends != text.count(",") + text.count(".") or text[:1] in (",", ".") or any(x in text for x in (" ,", " .", "\n,", "\n.")):
        return False
    return text.replace(",", "").replace(".", "").replace(" ", "").replace("\n", "").isalnum()


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, pattern: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path, pattern))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = encode(text.as_py() or "") + END
                n = len(ids) // 4
                start, end, piece = 0, n if n <= limit else n % limit or limit, 0
                while start < n:
                    for column, value in zip(out, (rid, doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]))):
                        column.append(value)
                    start, end, piece = end, end + limit, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i == 2 else pa.int64()) for i, v in enumerate(out)], names=["_rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class SumIndex:
    """A hash index of what sums to a gap: a single length, pairs and triples of the lengths that there are. Counts only fall, so
    a pair or triple that cannot be had any more is passed over once and never looked at again."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        limit = len(counts) - 1
        lengths = np.flatnonzero(counts[1:]) + 1
        reach = np.zeros(limit + 1, bool)
        #: Gap to the longer lengths of the pairs, and to the longest lengths of the triples, that sum to it, long to short.
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, np.ndarray] = {}
        for gap in range(2, limit + 1):
            longer = lengths[(2 * lengths >= gap) & (lengths < gap)][::-1]
            if len(found := longer[counts[gap - longer] > 0]):
                self.pairs[gap] = found
                reach[gap] = True
        for gap in range(3, limit + 1):
            longest = lengths[(3 * lengths >= gap) & (lengths < gap - 1)][::-1]
            if len(found := longest[reach[gap - longest]]):
                self.triples[gap] = found
        self.tried: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def _next(self, gap: int, at: int) -> int:
        """The place, from at on, of the first pair for gap that can be had; the number of pairs if none can."""
        longer = self.pairs[gap][at:]
        ok = (self.counts[longer] > 0) & (self.counts[gap - longer] > (2 * longer == gap))
        return at + (int(ok.argmax()) if ok.any() else len(ok))

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two available lengths that sum to gap, the longer as long as can be."""
        if gap not in self.pairs:
            return None
        at = self.tried[0][gap] = self._next(gap, self.tried[0].get(gap, 0))
        if at == len(self.pairs[gap]):
            return None
        a = int(self.pairs[gap][at])
        return a, gap - a

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three, the longest as long as can be."""
        found, at = self.triples.get(gap, ()), self.tried[1].get(gap, 0)
        while at < len(found):
            c = int(found[at])
            rest = gap - c
            if self.counts[c] > 0:
                # From the first pair of the rest that is not gone for good and has no part longer than c.
                pairs = self.pairs[rest]
                self.counts[c] -= 1
                k = self._next(rest, max(self.tried[0].get(rest, 0), int(np.searchsorted(-pairs, -c))))
                self.counts[c] += 1
                if k < len(pairs):
                    self.tried[1][gap] = at
                    return c, int(pairs[k]), rest - int(pairs[k])
            at += 1
        self.tried[1][gap] = at
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap exactly."""
        if gap and self.counts[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def longest(self, gap: int) -> int:
        found = np.flatnonzero(self.counts[: gap + 1])
        return int(found[-1]) if len(found) else 0


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), covering counts[length] pieces of each length."""
    index, out = SumIndex(np.array(counts, np.int64)), []
    for length in range(limit, 0, -1):
        while index.counts[length] > 0:
            pattern, gap = [length], limit - length
            index.counts[length] -= 1
            while gap:
                more = index.fill(gap) or ((x,) if (x := index.longest(gap)) else None)
                if more is None:
                    break
                for x in more:
                    index.counts[x] -= 1
                pattern, gap = [*pattern, *more], gap - sum(more)
            kinds = {x: pattern.count(x) for x in pattern}
            again = min(int(index.counts[x]) // m for x, m in kinds.items())
            for x, m in kinds.items():
                index.counts[x] -= again * m
            out.append((pattern, again + 1))
    return out


def _ranges(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[tuple[int, list[int]]]]]:
    """Per length: first ranks, and for each the first sequence and the offsets of its pieces in a sequence."""
    out: dict[int, tuple[list[int], list[tuple[int, list[int]]]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        places: dict[int, list[int]] = {}
        at = 0
        for x in pattern:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            ranks, what = out.setdefault(x, ([], []))
            ranks.append(used.get(x, 0))
            what.append((sequence, offsets))
            used[x] = used.get(x, 0) + times * len(offsets)
        sequence += times
    return out


def _place(ranges: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = [], []
            for length, rank in zip(rows["length"].tolist(), rows["rank"].tolist()):
                ranks, what = ranges[length]
                i = bisect_right(ranks, rank) - 1
                first, offsets = what[i]
                turn, slot = divmod(rank - ranks[i], len(offsets))
                sequence.append(first + turn)
                offset.append(offsets[slot])
            yield rows.drop(columns="rank").assign(sequence_id=np.array(sequence, np.int64), offset=np.array(offset, np.int64))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: _rid, doc_id, piece, start, length, ids_crc32, sequence_id, offset. tokenizer: path of a byte-level BPE file."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = with_row_id(stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    pieces = table(rows.select("_rid", "doc_id", "text").mapInArrow(_tokenize(str(path), public_tokenizers.PATTERN, limit), _PIECES), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most limit rows
        counts[length] = n
    ranges = _ranges(plan(counts, limit))
    # Each length is dealt to as many buckets as its pieces need; the list of these numbers is as long as a sequence.
    buckets = F.get(F.array(*(F.lit(max(1, int(n) // BUCKET)) for n in counts)), F.col("length").cast("int"))
    dealt = pieces.withColumn("b", F.pmod(F.xxhash64("_rid", "piece"), buckets))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "b").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("_rid", "piece"))).join(offsets, ["length", "b"])
    ranked = ranked.select("_rid", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank"))
    return ranked.mapInPandas(_place(ranges), _PIECES + ", sequence_id long, offset long")
