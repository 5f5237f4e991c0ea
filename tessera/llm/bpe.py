"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a batch are laid out as one array of symbols with links
to the next and previous symbol.  An index maps each merge rank to all
positions of its pair.  Ranks are taken in ascending order; all occurrences of
a pair are merged at once with numpy and only the lists of the pairs next to
them change.  A pair that a merge creates may have any rank, so active ranks
stand in a heap.  Results of pieces are kept per worker, in bounded room.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .kernels import buffer
from .tables import read

#: How byte-level tokenizers cut text before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker.
ROOM = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a ``tokenizers`` file of the byte-level BPE kind; ValueError for another."""

    def __init__(self, file: str):
        model = json.loads(file)
        if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
            raise ValueError("not a byte-level BPE tokenizer")
        if model["pre_tokenizer"].get("add_prefix_space") or model["model"].get("ignore_merges") or model["model"].get("byte_fallback"):
            raise ValueError("an option of this tokenizer is not supported")
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {}
        for t in model.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("an added token has options that are not supported")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.single = np.full(256, -1, np.int64)
        for c, b in letters.items():
            if c in vocab:
                self.single[b] = vocab[c]
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = self.left << 32 | self.right
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "split", "known")} | {"special": self.special}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.words, self.known = regex.compile(PATTERN), {}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        if not len(self.code):
            return np.full(len(a), -1)
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        n, ends = int(size.sum()), np.cumsum(size)
        sym = self.single[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[size > 0] - 1] = -1
        before[(ends - size)[size > 0]] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put pairs that start at these positions into the index."""
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            a, b = self.left[r], self.right[r]
            to = after[at]
            at = at[live[at] & (sym[at] == a) & (to >= 0) & (sym[to] == b)]
            if a == b and len(at) > 1:  # overlapping pairs of a run: every other one, from its left
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            to = after[gone]
            sym[at], live[gone], after[at] = self.made[r], False, to
            before[to[to >= 0]] = at[to >= 0]
            left = before[at]
            note(np.unique(np.concatenate([left[left >= 0], at[to >= 0]])))
        run = np.r_[0, np.cumsum(live)]
        return sym[live], run[ends] - run[ends - size]

    def learn(self, pieces: Iterable[str], chunk: int = 1 << 22) -> None:
        """Keep the ids (joined), their number and their bytes for each piece that is not kept yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > ROOM:
            self.known.clear()
            new = list(pieces)
        i = 0
        while i < len(new):
            part, held = [], 0
            while i < len(new) and (not part or held < chunk):
                part.append(new[i])
                held += len(new[i])
                i += 1
            ids, count = self.merge([p.encode() for p in part])
            ids, at = ids.tolist(), 0
            for p, c in zip(part, count.tolist()):
                own = ids[at : at + c]
                self.known[p] = (",".join(map(str, own)), c, b"".join(map(self.bytes.__getitem__, own)))
                at += c

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; added tokens are pieces of their own."""
        if self.split is None or not self.split.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids joined by commas, their number, and the bytes that they decode to."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*cut) - self.special.keys())
        known = self.known
        if self.special:
            known = self.known | {t: (str(i), 1, self.bytes[i]) for t, i in self.special.items()} if any(self.split.search(t) for t in texts) else known
        out = []
        for pieces in cut:
            got = [known[p] for p in pieces]
            out.append((",".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])))
        return out

    def encode(self, text: str) -> list[int]:
        joined = self.encode_batch([text])[0][0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; what is no UTF-8 becomes U+FFFD, unknown ids nothing."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def load(path: str) -> Codec:
    with open(path, encoding="utf-8") as f:
        return Codec(f.read())


def as_lists(got: list[tuple[str, int, bytes]]) -> pa.Array:
    """The ids of an encoded batch as an Arrow list column."""
    ends = np.cumsum([0, *[g[1] for g in got]]).astype(np.int32)
    flat = np.empty(ends[-1], np.int32)
    for g, a, b in zip(got, ends, ends[1:]):
        if b > a:
            flat[a:b] = np.array(g[0].split(","), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = True, chunk: int = 1 << 21) -> DataFrame:
    """``keep``, then ids (an array, or null unless asked for), n_tokens, ids_sha256 and decoded_sha256.

    Null text is empty; empty text has no ids.  Texts are never cut: pieces of
    white-space-free text may be as long as a text.  The file at ``path`` is
    read by the driver and sent to the tasks.
    """
    sent = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        codec = sent.value
        for batch in batches:
            _, offs = buffer(batch.column(len(keep)))
            i = 0
            while i < len(offs) - 1:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, "right")) - 1)
                got = codec.encode_batch([t or "" for t in batch.column(len(keep)).slice(i, j - i).to_pylist()])
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                yield pa.record_batch(
                    [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                    + [
                        as_lists(got) if ids else pa.nulls(j - i, pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64()),
                        sha(g[0].encode() for g in got), sha(g[2].decode("utf-8", "replace").encode() for g in got),
                    ],
                    names=[*keep, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                i = j

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return encode(read(spark, sf_dir, "documents"), default_path(), ["doc_id"], ids=False).drop("ids")
