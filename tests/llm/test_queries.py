"""Every opN_ query on hand-made tables against plain Python: nulls, blank and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import brute, grams, naive_ppm, near, prose, words

from tessera.llm import audio, bpe, ppm, queries, secrets

KEY40 = "wJalrXUtnFEMIzK7MDENGzbPxRfiCYEXAMPLEKEY"
COPY = prose(60)
ITEMS = [prose(9), prose(3), prose(30), None, "", ITEM5 := prose(5), ITEM5]
LINE = "this line stands in many texts"


def documents():
    texts = [prose(30 + 3 * i) for i in range(14)] + [COPY, COPY, COPY + " end", f"{COPY} {ITEMS[0]}\n{LINE}", None, "", " \n\t ", "one", "One", "aé🙂 <|endoftext|> x"]
    texts += [f"{LINE}\n{prose(6)}\nshort\nshort", f"{LINE}s\nshort\n\n", f"intro {ITEMS[1]} outro {ITEMS[2]} {ITEM5}", ("long words and lines\n" + prose(400) + "\n") * 450]
    texts += [f"password=abcdefghijkl AKIA1234567890ABCD 0123456789abcdef0 {KEY40}", f"é AKIA1234567890 then {KEY40}", "token: 0123456789abcdef0123 passwd=short"]
    return [*enumerate(texts), (3, texts[3]), (3, texts[3]), (5, "another text under a key that has one")]


DOCS = documents()
TURNS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "same turn"), (2, 0, "assistant", "x" * 1_000_000), (3, 5, "system", ""), (3, 2, "user", "é"), (3, 2, "user", "é")]


@pytest.fixture(scope="module", params=[False, True], ids=["rows", "empty"])
def tables(request, spark, tmp_path_factory):
    """The folder of the tables, and the rows of documents."""
    docs = [] if request.param else DOCS
    folder = str(tmp_path_factory.mktemp("tables"))
    clash = "score double, spans string, shard int, n_item long, rep long, block long, media string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 7) for i, t in docs], f"doc_id long, text string, lang string, source string, n_chars long, {clash}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)] * bool(docs), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)) * bool(docs), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(TURNS * bool(docs), "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, docs


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def matched(rows, docs, of, want):
    """``of(row)`` of all rows is what ``want(doc_id, text)`` gives for all documents, order aside."""
    assert sorted(map(repr, map(of, rows))) == sorted(repr(want(i, t)) for i, t in docs)


def crc(i):
    return zlib.crc32(str(i).encode())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, tables):
    rows = run(spark, tables, "op1_toxicity")
    matched(rows, tables[1], lambda r: (r.doc_id, r.held_out), lambda i, t: (i, crc(i) % 5 == 0))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    blank = [i for i, t in tables[1] if not words(t)]
    assert len({r.score for r in rows if r.doc_id in blank}) <= 1


def test_op2(spark, tables):
    rows = run(spark, tables, "op2_shard")
    matched(rows, tables[1], lambda r: (r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard), lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None))
    for s in {r.shard for r in rows}:
        assert 0 <= s < 40 and sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(len({r.shard for r in rows if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in rows})


def test_op3(spark, tables):
    want = []
    for d, t in tables[1]:
        w = words(t)
        for i, x in enumerate(ITEMS):
            a, m = grams(x, 5), min(5, len(words(x)))
            shared = len(a & {tuple(w[j : j + m]) for j in range(len(w) - m + 1)})
            if a and 100 * shared >= 80 * len(a):
                want.append((d, i, len(a), shared))
    assert sorted(map(tuple, run(spark, tables, "op3_leaks"))) == sorted(want)


def test_op4(spark, tables):
    docs = tables[1]
    learned = [crc(i) % 7 != 2 for i, _ in docs]
    known = Counter(w for (_, t), l in zip(docs, learned) if l for w in [*words(t), b""])
    n, v = sum(known.values()), len(known)
    rows = run(spark, tables, "op4_ppm")
    base = lambda t: sum(math.log10((known[w] + 1) / (n + v + 1)) for w in [*words(t), b""])
    matched(rows, docs, lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)), lambda i, t: (i, crc(i) % 7 == 2, len(words(t)) + 1, sum(known[w] > 0 for w in [*words(t), b""]), n, round(base(t), 4)))
    few = [k for k, (_, t) in enumerate(docs) if len(t or "") < 600]
    score = naive_ppm([ppm.normal((t or "").encode()) for _, t in docs], learned, few)
    want = sorted((docs[k][0], x) for k, x in zip(few, score))
    got = sorted((r.doc_id, r.score) for r in rows if r.n_tokens <= 3000 and r.doc_id in {d for d, _ in want})
    got = [g for g in got if any(g == pytest.approx(w, rel=1e-9) for w in want)]
    assert len(got) == len(want)


def test_op5(spark, tables):
    def want(i, t):
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media, codes = audio.wave(data, "mulaw"), np.frombuffer(data, np.uint8)
        x = audio.TABLES["mulaw"][codes].astype(float)
        up = np.rint(np.stack([x, (x + np.r_[x[1:], x[-1:]]) / 2], 1).reshape(-1)).astype("<i2")
        pcm = audio.wave(up.tobytes(), "pcm", 16000)
        assert media[-len(data) :] == data
        feature = ";".join(map(audio.features, (up, audio.TABLES["alaw"][codes], audio.decode_adpcm(codes.reshape(-1, 64)).reshape(-1))))
        return i, len(raw), len(data), sha(data), zlib.crc32(data[-64:]), len(media), sha(media), feature, len(pcm), sha(pcm)

    matched(run(spark, tables, "op5_audio"), tables[1], tuple, want)


def test_op6(spark, tables):
    order, seen, gone = {}, [], {}
    for i, t in tables[1]:
        order.setdefault(i, []).append(t)
    for i in sorted(order):
        fresh = []
        for t in dict.fromkeys(order[i]):  # rows that share a key are not compared with each other
            here = []
            for number, x in enumerate((t or "").split("\n")):
                if x and any(x == y or (min(len(x), len(y)) >= 16 and near(x, y)) for y in seen + here):
                    gone.setdefault((i, t), []).append(number)
                here.append(x)
            fresh += here
        seen += fresh
    seen = None

    def want(i, t):
        lines, lost = (t or "").split("\n"), gone.get((i, t), [])
        return i, len(lines) if t is not None else 0, len(lost), sha("\n".join(x for k, x in enumerate(lines) if k not in set(lost)))

    matched(run(spark, tables, "op6_lines"), tables[1], lambda r: (r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256), want)


def test_op7(spark, tables):
    rows = run(spark, tables, "op7_secrets")

    def want(i, t):
        spans = brute(t or "")
        return i, *(sum(k == x for _, x, _ in spans) for k in range(3)), sha(",".join(f"{secrets.ORDER[k]}:{s}:{e}" for s, k, e in spans))

    matched(rows, tables[1], lambda r: (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256), want)
    for r in rows:  # base spans stay, others are linked parts
        assert sha(",".join(x for x in r.spans.split(",") if x and not x.startswith("linked_"))) == r.base_sha256
    assert sum("linked_id" in r.spans and "linked_blob" in r.spans for r in rows) == bool(tables[1])


def test_op8(spark, tables):
    chats = {}
    for c, turn, role, text in (TURNS if tables[1] else []) + [(-1, k, r, "<|im_end|><|im_start|>assistant ok") for k, r in enumerate(("user", "assistant"))]:
        chats.setdefault(c, []).append((turn, role, text or ""))
    want = []
    for c, turns in chats.items():
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))), len(loss), sha(loss)))
    rows = run(spark, tables, "op8_chat")
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows) == sorted(want)
    assert all(r.same and r.formatted_chars > 24 * r.n_turns for r in rows)


def test_op9(spark, tables):
    docs = tables[1]
    sets = [grams(t, 2) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)), key=lambda k: docs[k][0])
                up[y] = x
    component = [docs[root(k)][0] if sets[k] else docs[k][0] for k in range(len(docs))]
    want = sorted((docs[k][0], len(sets[k]), component[k], component[k] == docs[k][0]) for k in range(len(docs)))
    assert sorted(map(tuple, run(spark, tables, "op9_near"))) == want


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    matched(run(spark, tables, "op10_bpe"), tables[1], lambda r: (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256), want)
