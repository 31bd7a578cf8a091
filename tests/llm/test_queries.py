"""Every registered query, with its own parameters, on the smallest tables against brute force: all contract columns."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from quillstream.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def table(name, columns, order=""):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet' {order}").fetchall()


@pytest.fixture(scope="module")
def docs():
    return [(d, t or "", s) for d, t, s in table("documents", "doc_id, text, source", "ORDER BY doc_id")]


def rows(spark, name, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, FOLDER).select(*columns).collect()]


def same(got, expected):
    assert Counter(got) == Counter(expected)


def test_op1(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = [(d, len(t.encode()), len(sp.encode(t))) for d, t, _ in docs]
    same(rows(spark, "op1_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit"), [(*x, x[2] > 4096) for x in n])


def test_op2(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for d, t, _ in docs:
        ids = sp.encode(t)
        expected.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids)), sp.decode(ids) == t))
    same(rows(spark, "op2_sentencepiece", "doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same_text"), expected)


def test_op3(spark, docs):
    split, least = [(d, WORD.findall(t)) for d, t, _ in docs], {}
    for d, w in split:
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            least[key] = min(least.get(key, d), d)
    expected = []
    for d, w in split:
        gone = {k for i in range(len(w) - 49) if least[tuple(w[i:i + 50])] < d for k in range(i, i + 50)}
        expected.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    same(rows(spark, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256"), expected)


def test_op4(spark, docs):
    prints = []
    for _, t, _ in docs:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = [d for d, _, _ in docs]
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    same(rows(spark, "op4_simhash", "doc_id", "fingerprint", "component_id"), [(d, f"{p:016x}", g) for (d, _, _), p, g in zip(docs, prints, group)])


def test_op5(spark, docs):
    expected = []
    for d, t, _ in docs:
        w = WORD.findall(t)
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        often = Counter(windows)
        again = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
                         len(w) < 20 or 100 * len(again) > 30 * len(w)))
    got = rows(spark, "op5_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([r[:7] for r in got], expected)
    assert not any(failed and kept for *_, failed, kept in got)


def word_ids(docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tokenizer.encode(t, add_special_tokens=False).ids for _, t, _ in docs]


def test_op6(spark, docs):
    pieces = {}
    for (d, _, _), ids in zip(docs, word_ids(docs)):
        ids = ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            pieces[d, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = rows(spark, "op6_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    same([(r[:2], r[2:5]) for r in got], list(pieces.items()))
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for placed in bins.values():
        placed.sort()
        assert [a for a, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))] and sum(n for _, n in placed) <= 2048
    bound = -(-sum(n for _, n, _ in pieces.values()) // 2048)
    assert len(bins) <= 1.03 * bound + 1


def test_op7(spark, docs):
    data = [(d, t.encode()) for d, t, _ in docs]
    often = Counter(hash(b[i:i + 400]) for _, b in data for i in range(len(b) - 399))
    expected = []
    for d, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if often[hash(b[i:i + 400])] > 1:
                gone[i:i + 400] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        expected.append((d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes())))
    same(rows(spark, "op7_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), expected)


def test_op8(spark):
    name = duckdb.sql(f"SELECT * FROM '{FOLDER}/embeddings.parquet' LIMIT 0").columns
    vec = next(c for c in name if c != "vec_id")
    found = table("embeddings", f"vec_id, {vec}", "ORDER BY vec_id")
    x, ids = np.array([v for _, v in found], dtype=np.float64), np.array([i for i, _ in found])
    got = {(r[0], r[1]): r[2:] for r in rows(spark, "op8_nearest_neighbours", "query_id", "rank", "vec_id", "score")}
    asked, hits = [i for i in ids.tolist() if i % 100 == 0], 0
    for q in asked:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]].tolist()
        mine = [got[q, k] for k in range(1, 11)]
        assert mine == sorted(mine, key=lambda r: (r[1], r[0]))
        assert all(abs(far[ids == i][0] - score) < 1e-12 for i, score in mine)
        hits += len(set(best) & {i for i, _ in mine})
    assert len(got) == 10 * len(asked) and hits >= 9 * len(asked)


def test_op9(spark):
    turns = {}
    for c, r, t in table("conversations", "conv_id, role, coalesce(text, '')", "ORDER BY conv_id, turn") + [(-1, r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]:
        turns.setdefault(c, []).append((r, t))
    escaped = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    expected = []
    for c, said in turns.items():
        learned = "".join(t for r, t in said if r == "assistant")
        formatted = sum(len(f"<|im_start|>{escaped(r)}\n{escaped(t)}<|im_end|>\n") for r, t in said)
        expected.append((c, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned), formatted))
    same(rows(spark, "op9_chat_formatting", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), expected)


def test_op10(spark, docs):
    expected, start = [], 0
    for (d, _, _), ids in zip(docs, word_ids(docs)):
        ids = ids + [2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(rows(spark, "op10_token_id_output", "doc_id", "start", "n_tokens", "ids_crc32"), expected)


def test_every_query_is_here_or_elsewhere():
    tested = {n.removeprefix("test_") for n in globals() if re.match(r"test_op\d+$", n)} | {"op11", "op12", "op13"}
    assert {n.split("_")[0] for n in queries.QUERIES} == tested
