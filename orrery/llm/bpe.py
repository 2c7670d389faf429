"""Byte-level BPE encoding and decoding through a pair occurrence index.

The distinct pieces (what the pre-tokenizer cuts) of a stretch of a partition are laid out as one chain of symbols. An
index maps each adjacent pair that has a rank to all its positions; ranks that are active are taken in ascending
order, all positions of a rank are merged (at once where there are many, else from left to right), and the lists of the
neighbouring pairs are updated. A merge only makes pairs of higher rank than its own, so the order is the one that each piece alone would see.

Null and empty texts give no ids and the empty decoded text. Texts of any length are taken whole; a piece is never cut. Equal rows give
equal results, an empty table an empty one; extra columns are ignored. Of equal pairs the first from the left is merged first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain as chained

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import release, ship, spread

#: Fixed value: how byte-level BPE vocabularies of this family cut text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text, where the standard library's engine is faster.
ASCII_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, about 250 bytes each, in two halves: when the newer one is full the older one goes.
REMEMBERED = 200_000
#: Texts are gathered until they hold so many bytes, so that the index works on many pieces at once.
GATHERED_BYTES = 1 << 20
#: Positions of one pair that are merged at once rather than one by one.
MANY = 32


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}


class Vocabulary:
    """Ranks, ids and bytes of a tokenizer file of the byte-level BPE kind."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in symbols.items()}
        nothing = (1 << 30) - 1  # parts pieces; larger than any id
        self.byte_ids = np.array([vocab[symbols[b]] for b in range(255)] + [nothing], np.int32)
        #: ranks of pairs by their left and then their right id, and the other way round; and by rank the two ids and the merged one
        self.after: dict[int, dict[int, int]] = {}
        self.ahead: dict[int, dict[int, int]] = {}
        self.left, self.right, self.merged = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.after.setdefault(vocab[left], {}).setdefault(vocab[right], rank)
            self.ahead.setdefault(vocab[right], {}).setdefault(vocab[left], rank)
            self.left.append(vocab[left])
            self.right.append(vocab[right])
            self.merged.append(vocab[left + right])
        self.byte_pair_ranks = np.full((256, 256), -1, np.int32)
        for a in range(255):
            for b in range(255):
                self.byte_pair_ranks[a, b] = self.after.get(int(self.byte_ids[a]), {}).get(int(self.byte_ids[b]), -1)
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of, default=0) + 1)]
        self.piece, self.ascii_piece = regex.compile(PIECE), re.compile(ASCII_PIECE, re.ASCII)
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None


def merge_all(pieces: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Token ids of each piece, all pieces together."""
    if not pieces:
        return []
    # byte FF is in no UTF-8 text: it parts the pieces, and is in no pair
    chain = np.frombuffer(b"\xff" + b"\xff".join(pieces) + b"\xff", np.uint8)
    n = len(chain)
    ids, following, before = v.byte_ids[chain], np.arange(1, n + 1), np.arange(-1, n - 1)
    id_at, next_at, last_at = memoryview(ids), memoryview(following), memoryview(before)  # one value is read faster through these
    # the index: all positions of each pair, by the pair's rank
    ranks = v.byte_pair_ranks[chain[:-1], chain[1:]]
    found = np.flatnonzero(ranks >= 0)
    found = found[np.argsort(ranks[found], kind="stable")]
    active, at = np.unique(ranks[found], return_index=True)
    active, at, found = active.tolist(), [*at.tolist(), len(found)], found.tolist()
    index: dict[int, list[int]] = {r: found[s:e] for r, s, e in zip(active, at, at[1:])}
    none: dict[int, int] = {}

    def add(i, x):
        if x in index:
            index[x].append(i)
        else:
            index[x] = [i]
            heapq.heappush(active, x)

    while active:
        r = heapq.heappop(active)
        left, right, new = v.left[r], v.right[r], v.merged[r]
        places = index.pop(r)
        after, ahead = v.after.get(new, none).get, v.ahead.get(new, none).get
        if len(places) >= MANY and left != right:  # such a pair can't overlap with itself
            i = np.array(places)
            i = i[ids[i] == left]
            j = following[i]
            right_ones = ids[j] == right
            i, j = i[right_ones], j[right_ones]
            ids[i], ids[j] = new, -1
            k = following[i] = following[j]
            before[k] = i
            h = before[i]
            for start, other, rank in ((i, k, after), (h, h, ahead)):
                for s, x in zip(start.tolist(), map(rank, ids[other].tolist())):
                    if x is not None:
                        add(s, x)
            continue
        if left == right:
            places.sort()
        for i in places:
            if id_at[i] != left:
                continue  # an overlapping merge took it
            j = next_at[i]
            if id_at[j] != right:
                continue
            id_at[i], id_at[j] = new, -1
            k = next_at[i] = next_at[j]
            last_at[k] = i
            if (x := after(id_at[k])) is not None:
                add(i, x)
            h = last_at[i]
            if (x := ahead(id_at[h])) is not None:
                add(h, x)
    alive, ends = ids >= 0, np.flatnonzero(chain == 255)
    alive[ends] = False
    upto, flat = np.cumsum(alive)[ends].tolist(), ids[alive].tolist()
    return [flat[s:e] for s, e in zip(upto, upto[1:])]


class Codec:
    """Encodes and decodes texts, remembering pieces."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: dict[str | int, tuple[int, ...]] = {}
        self.older: dict[str | int, tuple[int, ...]] = {}

    def _pieces(self, text: str) -> list:
        """Pieces of the text; an added token stands as its id."""
        if self.v.split_added is None or not any(a in text for a in self.v.added):
            return (self.v.ascii_piece if text.isascii() else self.v.piece).findall(text)
        out, at = [], 0
        for m in self.v.split_added.finditer(text):
            out += self.v.piece.findall(text[at : m.start()])
            out.append(self.v.added[m[0]])
            at = m.end()
        return out + self.v.piece.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self._pieces(t) for t in texts]
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for p in set().union(*cut).difference(known):
            if p in older:
                known[p] = older[p]
            elif p.__class__ is str:
                new.append(p)
            else:
                known[p] = (p,)
        for p, ids in zip(new, merge_all([p.encode() for p in new], self.v)):
            known[p] = tuple(ids)
        return [list(chained.from_iterable(map(known.__getitem__, ps))) for ps in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LAST: list = [None, None]


def codec_of(digest: str, spec) -> Codec:
    """The codec of the broadcast file; a worker keeps the last one, with the pieces it remembers, from task to task."""
    if _LAST[0] != digest:
        _LAST[:] = [None, None]
        _LAST[:] = [digest, Codec(Vocabulary(spec.value))]
    return _LAST[1]


def gathered(lengths: list[int]):
    """Bounds of stretches of texts that hold GATHERED_BYTES bytes or little more (a text is never cut)."""
    start = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= GATHERED_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gathered(df: DataFrame, id_col: str, text_col: str, path: str | None, schema: str, row) -> DataFrame:
    """row(codec, id, text, ids) of every document."""
    spark = df.sparkSession
    ship(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        text = f.read()
    spec, digest = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()  # one tokenizer file

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        codec = codec_of(digest, spec)
        for b in batches:
            lengths = [n or 0 for n in pc.binary_length(b.column(1)).to_pylist()]
            for s, e in gathered(lengths):
                part = b.slice(s, e - s)
                keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                rows = [row(codec, t, ids) for t, ids in zip(texts, codec.encode_batch(texts))]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c) for c in zip(*rows)]], names=[x.split(" ")[0] for x in schema.split(", ")])
        release()

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(codec, _, ids):
        return len(ids), sha(",".join(map(codec.v.decimal.__getitem__, ids)).encode()), sha(codec.decode(ids).encode())

    kind = docs.schema[id_col].dataType.simpleString()
    return _gathered(docs, id_col, text_col, path, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded (the text again)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _gathered(docs, id_col, text_col, path, f"{id_col} {kind}, ids array<bigint>, decoded string", lambda codec, _, ids: (ids, codec.decode(ids)))
