"""Language-model scores by prediction by partial matching (PPM).

A text is read as its lower-case words, one space after each but the last and a
line feed at the end.  Each byte is predicted from the bytes before it, across
word breaks.  The longest context comes first and each hands on what it never
saw by an escape, leaving its own symbols out below (symbol exclusion):

1. the last ``deep`` bytes, as they stood earlier in the same text (adaptive;
   a text restarts this level every mebibyte, as bounded PPM models do).  Its
   escape is estimated from how often contexts of the same age and number of
   symbols escaped earlier in the text;
2. the last ``order`` bytes, then one less and so on to none, in the byte trie
   of all training texts, with escapes by method C: as many times as there are
   different symbols;
3. all bytes that no training text has, alike.

The result is a distribution over texts, so scores are code lengths.

Nothing holds the trie or the vocabulary whole.  Texts are packed into blocks of
bounded size.  A block sends its distinct words and its distinct contexts with a
symbol to buckets, as sorted and compressed arrays; contexts with the same last
three bytes share a bucket, so a bucket sees all it needs but the orders 0 to 2.
Buckets add up the counts, build their part of the trie and send code lengths
back.  Buckets with much traffic are dealt over salts, and their answers too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import read, stored

U = np.uint64
ORDER, DEEP = 5, 12
SPACE, END = 0x20, 0x0A
#: Symbols that are looked at together; the adaptive level restarts after so many.
SPAN = 1 << 20
#: Prior escape probabilities of adaptive contexts with one symbol, by how often they came, then with two symbols and with more.
ESCAPES, STRENGTH = (0.2, 0.05, 0.02, 0.01, 0.4, 0.5), 4.0
WORD, GRAM = 0, 1
ROW = "block long, kind int, bucket int, salt int, keys binary, vals binary"


def normal(raw: bytes | None) -> bytes:
    """Lower-case words between ASCII white space, joined by a space, and the end."""
    return b" ".join((raw or b"").lower().split()) + b"\n"


def squeeze(a: np.ndarray) -> bytes:
    """8-byte values by byte planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def loosen(data: bytes, kind=U) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).reshape(-1)


def put_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=U(0)))


def get_keys(data: bytes) -> np.ndarray:
    return np.cumsum(loosen(data))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of each one's counts."""
    key, n = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def words(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of the words of whole texts, and each one's text, by chunks.  The end of a text is not among them."""
    i = 0
    while i < len(bodies):
        j, held = i, 0
        while j < len(bodies) and (j == i or held + len(bodies[j]) <= SPAN):
            held += len(bodies[j])
            j += 1
        data = np.frombuffer(b"".join(bodies[i:j]), np.uint8)
        offs = np.cumsum([0, *map(len, bodies[i:j])])
        start, end, row = K.spans(data, offs)
        yield K.hashes(data, start, end) | U(1), row + i  # 0 stands for the end
        i = j


def symbols(bodies: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: gram (the ``order`` bytes before, then the symbol) and segment of each symbol, all bytes, and the text of each segment.

    A text above ``SPAN`` is several segments; contexts reach back across their cuts.
    """
    held: list[tuple[int, bytes, bytes]] = []

    def out():
        data = np.frombuffer(b"".join(lead + part for _, lead, part in held), np.uint8)
        size = np.array([len(part) for _, _, part in held])
        keep = np.ones(len(data), bool)
        start = np.cumsum(size + order) - size - order
        for j in range(order):
            keep[start + j] = False
        gram = np.zeros(len(data) - order, U)
        for j in range(order + 1):
            gram = gram << U(8) | data[j : j + len(gram)].astype(U)
        return gram[keep[order:]], np.repeat(np.arange(len(held)), size), data[keep], np.array([i for i, _, _ in held])

    n = 0
    for i, body in enumerate(bodies):
        for at in range(0, len(body), SPAN):
            part = body[at : at + SPAN]
            if held and n + len(part) > SPAN:
                yield out()
                held, n = [], 0
            held.append((i, (b"\n" * order + body[max(0, at - order) : at])[-order:], part))
            n += len(part)
    if held:
        yield out()


def adapted(data: np.ndarray, segment: np.ndarray, log_p: np.ndarray, deep: int = DEEP) -> np.ndarray:
    """log10 of the probability of each symbol with the adaptive level over the trained ``log_p``.

    Each symbol's context is the ``deep`` bytes (a multiple of 4) before it in
    its segment.  Excluded symbols leave the trained distribution with what
    they have there, which is known from the place where each came first.
    """
    n = len(data)
    if n <= deep:
        return log_p
    wide = np.zeros(n, U)
    for j in range(4):
        wide[: n - 3] = wide[: n - 3] << U(8) | data[j : n - 3 + j].astype(U)
    h = K.mix(segment[deep:].astype(U) + U(1))
    for j in range(0, deep, 4):
        h = (h ^ wide[j : j + n - deep]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    h = K.mix(h)
    # Most contexts never come back: a table of their hashes' first bits leaves those out.
    bits = max(8, int(n - 1).bit_length() + 2)
    slot = (h >> U(64 - bits)).astype(np.int64)
    inside = segment[deep:] == segment[: n - deep]
    at = np.flatnonzero(inside & (np.bincount(slot[inside], minlength=1 << bits)[slot] > 1))
    at = at[np.argsort(h[at], kind="stable")]
    h, at = h[at], at + deep
    if not len(at):
        return log_p
    new = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.arange(len(at)) - first[group]  # times the context came before
    code = group << 8 | data[at]
    by = np.argsort(code, kind="stable")
    code = code[by]
    run = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    count = np.empty(len(at), np.int64)  # times the symbol came in it
    count[by] = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    fresh = count == 0
    seen = np.cumsum(fresh) - fresh
    kinds = seen - seen[first][group]
    gone = np.cumsum(np.where(fresh, 10.0 ** log_p[at], 0.0))
    gone -= np.where(fresh, 10.0 ** log_p[at], 0.0)
    left = 1.0 - (gone - gone[first][group])
    state = np.where(kinds == 1, np.minimum(total, 4) - 1, np.minimum(kinds, 3) + 2)
    escape = np.zeros(len(at))
    met = np.flatnonzero(total > 0)
    met = met[np.argsort(at[met], kind="stable")]
    for s, prior in enumerate(ESCAPES):  # what the same state did earlier in the segment
        own = met[state[met] == s]
        if len(own):
            of = segment[at[own]]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[start, len(own)])
            miss = np.cumsum(fresh[own]) - fresh[own]
            miss = miss - np.repeat(miss[start], size)
            escape[own] = (miss + prior * STRENGTH) / (np.arange(len(own)) - np.repeat(start, size) + STRENGTH)
    out = log_p.copy()
    hit, miss = np.flatnonzero(~fresh), np.flatnonzero(fresh & (total > 0))
    out[at[hit]] = np.log10((1 - escape[hit]) * count[hit] / total[hit])
    out[at[miss]] += np.log10(escape[miss]) - np.log10(np.maximum(left[miss], 1e-12))
    return out


class Trie:
    """Counts of (context, symbol) of every order, and the code length of any symbol in any context."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, order: int = ORDER, low: tuple = ()):
        """``low``: grams and counts of the lowest orders, where ``gram`` has a part of the contexts only."""
        self.order, self.levels = order, []
        for k in range(order + 1):
            value, many = low[k] if k < len(low) else (gram, count)
            key, at = np.unique(value & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, many.astype(float), len(key))
            node, of = np.unique(key >> U(8), return_inverse=True)
            self.levels.append([key, n, node, np.bincount(of, n, len(node)), np.bincount(of, minlength=len(node)).astype(float), of])
        for k in range(order, 0, -1):
            # What the next shorter context has left once the symbols of this one are left out.
            key, n, node, total, kinds, of = self.levels[k]
            up_key, up_n, up_node, up_total, up_kinds, _ = self.levels[k - 1]
            mask = U((1 << 8 * k) - 1)
            out = np.bincount(of, up_n[np.searchsorted(up_key, key & mask)], len(node))
            parent = np.searchsorted(up_node, node & U((1 << 8 * (k - 1)) - 1) if k > 1 else node * U(0))
            self.levels[k] = [key, n, node, total, kinds, up_total[parent] - out, up_kinds[parent] - kinds]
        self.levels[0] = self.levels[0][:5]

    @staticmethod
    def _find(keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
        return at, keys[at] == value

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each packed symbol in its context."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        total, kinds = np.full(len(gram), -1.0), np.zeros(len(gram))  # what is left at this level; -1: not entered yet
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            value = gram[todo] & U((1 << 8 * (k + 1)) - 1)
            node, known = self._find(level[2], value >> U(8))
            entered = total[todo] >= 0
            here = known | entered
            t = np.where(entered, total[todo], level[3][node] if len(level[3]) else 0)
            d = np.where(entered, kinds[todo], level[4][node] if len(level[4]) else 0)
            at, hit = self._find(level[0], value)
            hit &= here
            with np.errstate(divide="ignore"):
                out[todo[hit]] += np.log10(level[1][at[hit]] / (t[hit] + d[hit]))
                miss = here & ~hit & (d > 0)
                out[todo[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            if k:
                go = known & ~hit
                total[todo[go]], kinds[todo[go]] = level[5][node[go]], level[6][node[go]]
            todo = todo[~hit]
        out[todo] -= np.log10(max(1, 256 - len(self.levels[0][0])))
        return out


class Finder:
    """Values of sorted keys, found through a table of their hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = U(64 - max(8, int(len(keys)).bit_length() + 2))
        self.table = np.zeros(1 << int(U(64) - self.shift), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def _rows(block: int, kind: int, key: np.ndarray, vals: np.ndarray, bucket: np.ndarray, salt: int) -> Iterator[tuple]:
    by = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    for part in np.split(by, cut[1:]) if len(by) else ():
        yield block, kind, int(bucket[part[0]]), salt, put_keys(key[part]), squeeze(vals[part])


def _batch(rows: list[tuple], schema: str = ROW) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def unpacked(table) -> Iterator[bytes]:
    """The texts of a table of packed ones, one at a time."""
    codec = pa.Codec("zstd")
    for packed, size in zip(table.column("packed").to_pylist(), table.column("size").to_pylist()):
        yield codec.decompress(packed, size, asbytes=True)


def score(df: DataFrame, key: str, text: str, learn, order: int = ORDER, deep: int = DEEP, block_bytes: int = 24 << 20) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn`` is a condition: rows that are trained on (none if it is null).
    Null and blank texts are empty and have their end only.  Repeated rows, and
    rows that share a key or have none, each count and each get their row.
    Texts may be of any length; nothing of them is left out.  An empty table
    gives no rows; without training rows every byte is alike.  Columns of
    ``df`` beside ``key`` and ``text`` play no part; ``key`` may not have the
    name of a new column.  Words count by 64-bit hashes.
    """
    spark = df.sparkSession
    if not 3 <= order <= 7 or deep % 4 or deep < order:
        raise ValueError("order is from 3 to 7, deep a multiple of 4 and no less than order")
    if key in ("n_tokens", "n_known", "train_tokens", "base_score", "score"):
        raise ValueError(f"the key's name is that of a new column: {key}")
    kind = df.schema[key].dataType.simpleString()
    body = df.select(F.col(key).alias("_key"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(text).cast("binary").alias("_body"))
    size = body.agg(F.coalesce(F.sum(F.octet_length("_body")), F.lit(0))).first()[0]
    buckets = int(min(4096, max(8, -(-size // (16 << 20)))))
    salts = int(max(1, -(-size // (buckets * (64 << 20)))))

    def pack(batches):
        codec, part = pa.Codec("zstd"), TaskContext.get().partitionId() << 32
        number, held = 0, 0
        for b in batches:
            rows = []
            for raw in b.column(2).to_pylist():
                text_ = normal(raw)
                if held and held + len(text_) > block_bytes:
                    number, held = number + 1, 0
                held += len(text_)
                rows.append((part + number, len(text_), codec.compress(text_, asbytes=True)))
            yield pa.record_batch([b.column(0), b.column(1), *_batch(rows, "block long, size long, packed binary").columns], names=["key", "learn", "block", "size", "packed"])

    docs = stored(spark, body.mapInArrow(pack, f"key {kind}, learn boolean, block long, size long, packed binary"), "packed")

    def ask(bodies: list[bytes], learned: list[bool], block: int) -> pa.RecordBatch:
        rows, salt = [], int(K.mix(np.array([block], np.int64).view(U))[0] % U(salts))
        got: list = [([], []), ([], [])]
        for training in (True, False):
            own = [t for t, l in zip(bodies, learned) if l is training]
            ends = [(np.zeros(1, U), np.array([len(own) * training]))] if own else []
            for kind_, values in ((WORD, (w for w, _ in words(own))), (GRAM, (g for g, *_ in symbols(own, order)))):
                for v in values:
                    v, n = np.unique(v, return_counts=True)
                    got[kind_][0].append(v)
                    got[kind_][1].append(n * training)
            got[WORD][0].extend(k for k, _ in ends)
            got[WORD][1].extend(n for _, n in ends)
        for kind_ in (WORD, GRAM):
            k, n = added(*got[kind_])
            near = k if kind_ == WORD else k >> U(8) & U(0xFFFFFF)
            rows += _rows(block, kind_, k, n, (K.mix(near + U(3)) % U(buckets)).astype(np.int64), salt)
        return _batch(rows)

    def gather(batches):
        held, learned, block, n = [], [], None, 0
        for b in batches:
            for t, l, own in zip(unpacked(b), b.column("learn").to_pylist(), b.column("block").to_pylist()):
                if held and (own != block or n > block_bytes):
                    yield ask(held, learned, block)
                    held, learned, n = [], [], 0
                held.append(t)
                learned.append(l)
                block, n = own, n + len(t)
        if held:
            yield ask(held, learned, block)

    asked = stored(spark, docs.mapInArrow(gather, ROW), "asked")

    def add(table: pa.Table) -> pa.Table:
        keys, n = added([get_keys(x) for x in table.column("keys").to_pylist()], [loosen(x, np.int64) for x in table.column("vals").to_pylist()])
        return pa.Table.from_batches([_batch([(0, table.column("kind")[0].as_py(), table.column("bucket")[0].as_py(), 0, put_keys(keys), squeeze(n))])])

    sums = asked.groupBy("kind", "bucket", "salt").applyInArrow(add, ROW)
    if salts > 1:
        sums = sums.groupBy("kind", "bucket").applyInArrow(add, ROW)
    sums = stored(spark, sums, "sums")

    def tally(batches):
        """Training tokens and distinct ones; counts of the orders 0 to 2, and the last two bytes of contexts that a bucket needs those for."""
        for b in batches:
            for kind_, bucket, k, v in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "keys", "vals"))):
                k, n = get_keys(k), loosen(v, np.int64)
                if kind_ == WORD:
                    yield pa.record_batch([pa.array([0, 0]), pa.array([-1, -2]), pa.array([int(n.sum()), int((n > 0).sum())])], names=["bucket", "gram", "n"])
                else:
                    low, at = np.unique(k & U(0xFFFFFF), return_inverse=True)
                    yield pa.record_batch([pa.array(np.full(len(low), bucket)), pa.array(low.astype(np.int64)), pa.array(np.bincount(at, n.astype(float), len(low)).astype(np.int64))], names=["bucket", "gram", "n"])

    tallied = stored(spark, sums.mapInArrow(tally, "bucket long, gram long, n long"), "low")
    whole = dict(tallied.filter("gram < 0").groupBy("gram").agg(F.sum("n")).collect())
    total, distinct = whole.get(-1, 0), whole.get(-2, 0)
    three = tallied.filter("gram >= 0").withColumn("two", F.shiftright("gram", 8))
    low = three.groupBy("gram", "two").agg(F.sum("n").alias("n")).filter("n > 0")
    one = low.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 65536
    sent = spark.sparkContext.broadcast((one.column("gram").to_numpy().astype(U), one.column("n").to_numpy()))
    need = three.select(F.col("bucket").cast("int").alias("bucket"), "two").distinct().join(low, "two").select("bucket", "gram", "n")

    def model(own: pa.Table, low_: pa.Table) -> pa.Table:
        bucket = own.column("bucket")[0].as_py()
        keys, n = added([get_keys(x) for x in own.column("keys").to_pylist()], [loosen(x, np.int64) for x in own.column("vals").to_pylist()])
        trie = Trie(keys[n > 0], n[n > 0], order, (sent.value, sent.value, (low_.column("gram").to_numpy().astype(U), low_.column("n").to_numpy())))
        return pa.Table.from_batches([_batch([(0, GRAM, bucket, 0, put_keys(keys), squeeze(trie.log10(keys)))])])

    lengths = sums.filter(F.col("kind") == GRAM).groupBy("bucket").cogroup(need.groupBy("bucket")).applyInArrow(model, ROW)
    counts = sums.filter(F.col("kind") == WORD)
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    answers = stored(spark, lengths.unionByName(counts), "answers").withColumn("salt", spread)

    def reply(own: pa.Table, known: pa.Table) -> pa.Table:
        kind_ = own.column("kind")[0].as_py()
        find = Finder(get_keys(known.column("keys")[0].as_py()), loosen(known.column("vals")[0].as_py(), np.float64 if kind_ == GRAM else np.int64))
        rows = []
        for block, k in zip(own.column("block").to_pylist(), own.column("keys").to_pylist()):
            rows.append((block, kind_, 0, 0, k, squeeze(find(get_keys(k)))))
        return pa.Table.from_batches([_batch(rows)])

    by = ("kind", "bucket", "salt")
    replies = asked.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(reply, ROW)

    def table_of(replies: pa.Table, kind_: int, dtype) -> Finder:
        of = np.flatnonzero(replies.column("kind").to_numpy() == kind_)
        keys, vals = (replies.column(c).take(pa.array(of)).to_pylist() for c in ("keys", "vals"))
        k = np.concatenate([get_keys(x) for x in keys])
        v = np.concatenate([loosen(x, dtype) for x in vals])
        k, at = np.unique(k, return_index=True)
        return Finder(k, v[at])

    def finish(texts: pa.Table, replies: pa.Table) -> pa.Table:
        find, length = table_of(replies, WORD, np.int64), table_of(replies, GRAM, np.float64)
        bodies = list(unpacked(texts))
        n = len(bodies)
        end = int(find(np.zeros(1, U))[0])
        base = np.full(n, np.log10((end + 1) / (total + distinct + 1)))
        tokens, known, log_p = np.ones(n, np.int64), np.full(n, int(end > 0), np.int64), np.zeros(n)
        for h, row in words(bodies):
            c = find(h)
            base += np.bincount(row, np.log10((c + 1.0) / (total + distinct + 1.0)), n)
            tokens += np.bincount(row, minlength=n)
            known += np.bincount(row[c > 0], minlength=n)
        for gram, segment, data, of in symbols(bodies, order):
            log_p += np.bincount(of, np.bincount(segment, adapted(data, segment, length(gram), deep), len(of)), n)
        return pa.table([texts.column("key"), pa.array(tokens), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(log_p)], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.drop("learn").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document under words alone and under PPM, learned from those that are not held out."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    out = score(read(spark, sf_dir, "documents"), "doc_id", "text", ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
