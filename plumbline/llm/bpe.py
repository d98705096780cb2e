"""Byte-level BPE: an exact backtracking encoder and an offset-table decoder.

Of a pretoken all vocabulary entries that occur are found in one Aho-Corasick
pass, which gives the longest entry at each place. The encoder walks left to
right with the longest entry, and keeps it only if the pair with the entry before is
compatible: merging the two entries' bytes by rank would give back these two
entries. Where no entry fits, it steps back and tries the next shorter one. A
prefix of compatible neighbours is the merge result of its bytes, so the first
walk to reach the end is the exact encoding, and every place is left for good
at most once.

Texts go through Arrow batches, split by the GPT-2 style pattern; encoded
pretokens are kept in a table of bounded size. Decoding gathers bytes from one
blob by its offset table.

Defined cases: a null text counts as empty and encodes to no ids. The special
token's string in a text is that token, as the tokenizers library has it.
Pretokens of any length take memory in proportion to their length. Repeated rows
each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import table

# The fixed pattern of byte-level BPE vocabularies; it splits text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: So many encoded pretokens, of at most KEPT_CHARS characters, are remembered by a worker.
KEPT, KEPT_CHARS = 400_000, 32


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Entries, ranks and splits of a byte-level BPE file of the tokenizers library.

    Entries are byte strings by id. left/right hold the pair that merges to an
    entry, or -1 for one that no merge makes; merges maps pairs to (rank, id).
    """

    def __init__(self, spec: dict):
        of = {c: b for b, c in enumerate(byte_alphabet())}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.entries: list[bytes] = [b""] * size
        for s, i in ids.items():
            if s not in self.special:
                self.entries[i] = bytes(of[c] for c in s)
        for s, i in self.special.items():
            self.entries[i] = s.encode()
        self.left, self.right = [-1] * size, [-1] * size
        self.rank = [-1] * size
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = (rank, z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
        special = set(self.special.values())
        self.byte_id = [-1] * 256
        for i, e in enumerate(self.entries):
            if len(e) == 1 and i not in special:
                self.byte_id[e[0]] = i
        # an entry can come out of merging only if it is a byte or its own bytes merge to it
        self.usable = {i for i, e in enumerate(self.entries) if len(e) == 1 and i not in special}
        for i in sorted((i for i, r in enumerate(self.rank) if r >= 0), key=self.rank.__getitem__):
            x, y = self.left[i], self.right[i]
            if x in self.usable and y in self.usable and self.apart(x, y, last=True):
                self.usable.add(i)
        self.id_of = {self.entries[i].decode("latin-1"): i for i in self.usable}
        self.offsets = np.cumsum([0, *map(len, self.entries)])
        self.blob = np.frombuffer(b"".join(self.entries), np.uint8)

    def apart(self, x: int, y: int, last: bool = False) -> bool:
        """Whether merging the bytes of x and y by rank leaves exactly x, y (last: until the two merge).

        The entries next to the border are undone from whole ones down to bytes, the
        later merge first; of equal ranks the right one is later, as merging goes from
        the left. No merge across the border may come before the one undone last.
        """
        undone, of_right, first = 0, False, True
        while True:
            crossing = self.merges.get((x, y))
            if crossing is not None and not (first and last) and (first or crossing[0] < undone or (crossing[0] == undone and of_right)):
                return False
            first = False
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                undone, of_right, x = rx, False, self.right[x]
            else:
                undone, of_right, y = ry, True, self.left[y]


class Encoder:
    """Exact encodings of pretokens and texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        v = self.v = vocabulary
        self.kept, self.known, self.pairs = kept, {}, {}
        self.found = ahocorasick.Automaton()
        for s, i in v.id_of.items():
            self.found.add_word(s, (len(s), i))
        self.found.make_automaton()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def compatible(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as pairs come up."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= 4 * self.kept:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.v.apart(a, b)
        return ok

    def pretoken(self, data: bytes) -> list[int]:
        """The ids of one pretoken's bytes."""
        n = len(data)
        if n == 1:
            return [self.v.byte_id[data[0]]]
        text = data.decode("latin-1")
        whole = self.v.id_of.get(text)
        if whole is not None:
            return [whole]
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (end, entry) by place; shorter ones end, and so come, first
        for end, (size, i) in self.found.iter(text):
            at[end + 1 - size].append((end + 1, i))
        known, compatible = self.pairs, self.compatible
        path, places, dead = [], [], set()
        place, last = 0, -1
        while place < n:
            here = at[place]
            while here:  # an entry tried is gone: places are entered once, and those left backwards are dead
                end, i = here.pop()
                if end in dead:
                    continue
                ok = True if last < 0 else known.get((last, i))
                if ok or (ok is None and compatible(last, i)):
                    path.append(i)
                    places.append(place)
                    place, last = end, i
                    break
            else:
                # nothing fits here after last: last is wrong, and so is ending an entry here
                if not path:
                    raise ValueError("the vocabulary has no entry for a byte of the text")
                dead.add(place)
                path.pop()
                place, last = places.pop(), path[-1] if path else -1
        return path

    def ordinary(self, text: str, out: list[int]) -> None:
        known = self.known
        for w in SPLIT.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.pretoken(w.encode())
                if len(w) <= KEPT_CHARS:
                    if len(known) >= self.kept:
                        known.clear()
                    known[w] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.special is None or not any(s in text for s in self.v.special):
            self.ordinary(text, out)
            return out
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.v.special[part])
            elif part:
                self.ordinary(part, out)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each entry's bytes, gathered from the blob; broken UTF-8 becomes U+FFFD."""
        starts, ends = self.v.offsets[ids], self.v.offsets[ids + 1]
        sizes = ends - starts
        total = int(sizes.sum())
        if not total:
            return ""
        firsts = np.cumsum(sizes) - sizes
        places = np.arange(total) - np.repeat(firsts - starts, sizes)
        return self.v.blob[places].tobytes().decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(spark: SparkSession, path: str | None = None):
    """A broadcast of the vocabulary file's text, read on the driver; its size is that of one file (a few MB)."""
    return spark.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """The encoder of a vocabulary file's text, made once in a worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(json.loads(text)))
    return _ENCODERS[key]


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df's rows as ``row``, with ids (array<int>) and the decoded text."""
    vocabulary = load(df.sparkSession, path)

    flat = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = flat.select("row").schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in it:
            ids, decoded = [], []
            for t in b.column("text"):
                got = np.array(enc.encode(t.as_py()), np.int32)
                ids.append(got)
                decoded.append(enc.decode(got))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["row", "ids", "decoded"])

    return flat.mapInArrow(batches, kind.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string"))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, without the ids leaving the worker."""
    vocabulary = load(df.sparkSession, path)
    flat = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in it:
            n, one, two = [], [], []
            for t in b.column("text"):
                ids = np.array(enc.encode(t.as_py()), np.uint32)
                n.append(len(ids))
                one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(enc.decode(ids.astype(np.int64)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = flat.select("doc_id").schema
    return flat.mapInArrow(batches, kind.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
