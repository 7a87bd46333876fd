"""Problem 8: the whole corpus as ids of a byte-level BPE vocabulary.

The merges are done here: a priority queue of merge ranks over a doubly linked list of symbols, in which entries that
a merge has made stale are skipped."""

from __future__ import annotations

import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches
from millrace.runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern of byte-level vocabularies of this kind (fixed value), and the same for texts of ASCII only.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: A worker keeps the ids of at most so many different pieces of text.
_CACHE_PIECES = 200_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + n))
        n += b not in plain
    return out


class BytePairs:
    """A byte-level BPE vocabulary: encode, decode."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)["model"]
        letters = _byte_letters()
        self._byte = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        self._single = [ids[c] for c in letters]
        self._merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self._merges[ids[a], ids[b]] = (rank, ids[a + b])
        self._bytes = {i: bytes(self._byte[c] for c in t if c in self._byte) for t, i in ids.items()}
        self._known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the pair of least rank, the leftmost of equals."""
        sym = [self._single[b] for b in piece]
        n, merges = len(sym), self._merges
        if n < 2:
            return sym
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapify(queue)
        while queue:
            _, i, a, b, merged = heappop(queue)
            j = nxt[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = merged, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if m := merges.get((merged, sym[k])):
                    heappush(queue, (m[0], i, merged, sym[k], m[1]))
            if (h := prev[i]) >= 0 and (m := merges.get((sym[h], merged))):
                heappush(queue, (m[0], h, sym[h], merged, m[1]))
        return [s for s in sym if s >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        known = self._known
        pieces = (_ASCII if text.isascii() else _SPLIT).findall(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = array("i", self.merge(p.encode("utf-8", "surrogatepass"))).tobytes()
                    if len(p) <= 64:
                        if len(known) >= _CACHE_PIECES:
                            known.clear()
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, BytePairs] = {}


def _loaded(content: str) -> BytePairs:
    """One encoder in each worker, whatever number of tasks it runs."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BytePairs(content)
    return _LOADED[key]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids: the text's ids without special tokens; what spells out a special token is ordinary text.

    An empty text gives an empty list, a null text null, a blank text its ids; repeated rows are encoded each. No
    shuffle. The vocabulary file (about 1.5 MB, read on the driver) is broadcast; executors need no copy of it."""
    with open(vocabulary, encoding="utf-8") as f:
        kept = df.sparkSession.sparkContext.broadcast(f.read())

    def of(b: pa.RecordBatch):
        coder = _loaded(kept.value)
        packed = [None if t is None else coder.packed(t) for t in b.column(1).to_pylist()]
        ends = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([0 if p is None else len(p) // 4 for p in packed], out=ends[1:])
        values = pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32))
        ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([p is None for p in packed]))
        yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(spread(own, "doc_id"), of, "doc_id long, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, text: the vocabulary's strings put together; null ids give null."""
    with open(vocabulary, encoding="utf-8") as f:
        kept = df.sparkSession.sparkContext.broadcast(f.read())

    def of(b: pa.RecordBatch):
        coder = _loaded(kept.value)
        texts = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), of, "doc_id long, text string")
