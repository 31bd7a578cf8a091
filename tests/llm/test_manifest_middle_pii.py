"""Merkle manifest, fill-in-the-middle and personal data against brute-force versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import merkle, middle_fill, pii, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, idx int, row int, h1 int, output int, base int, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, "y") for r in rows], SCHEMA).repartition(3)


def same(got, expected):
    assert Counter(map(tuple, got)) == Counter(expected)


# --- manifest ---------------------------------------------------------------------

def leaf_of(row, n_chars=None):
    doc_id, source, lang, n, text = row
    values = [doc_id, source, lang, n if n_chars is None else n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + fanout])))
        at //= fanout
    return out


def plain_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: tree([leaf_of(r) for r in groups[g]], fanout) for g in groups}
    top = tree([trees[g][-1][0] for g in order], fanout) if rows else []
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i, fanout) + path(top, at, fanout)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, r[3] + 1) if hit else leaf_of(r)
            for left, right in steps:
                node = sha(left + node + right)
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def awkward(n=150):
    rng = random.Random(4)
    rows = [(i * rng.choice([1, 1, 97, 10**12]) * rng.choice([1, -1]), rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", None, "", "é", "-"]),
             rng.choice([i, None, 2**63 - 1]), rng.choice([None, "", "a", "é漢🙂", "x" * 5000])) for i in range(n)]
    rows += [(None, "s", "en", 1, "t")] * 3 + [(None, "s", None, 1, "u"), (5, "s", "en", 1, "a"), (5, "s", "en", 1, "b"), (5, "s", "en", 1, "a"), (5, "s", "zz", 7, "alone")]
    return rows + rows[:9]


def test_manifest(spark):
    rows = awkward()
    same(merkle.digests(table(spark, rows)).collect(), plain_manifest(rows))


@pytest.mark.parametrize("fanout, slots", [(2, 4), (3, 9), (5, 1024)])
def test_manifest_of_several_rounds(spark, monkeypatch, fanout, slots):
    monkeypatch.setattr(merkle, "SLOTS", slots)
    monkeypatch.setattr(merkle, "BRANCH_BITS", 5)
    rows = awkward(100)
    got = merkle.manifest(table(spark, rows), fanout=fanout).select("doc_id", "leaf", "subroot", "root", merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")))
    want = plain_manifest(rows, fanout)
    same(got.collect(), [(d, leaf, sub, root, root) for d, leaf, sub, root, *_ in want])


def test_manifest_of_few_rows(spark):
    assert merkle.digests(table(spark, [])).count() == 0
    one = [(0, None, None, None, None)]
    same(merkle.digests(table(spark, one)).collect(), plain_manifest(one))
    assert plain_manifest(one)[0][1] == plain_manifest(one)[0][3]
    for rows in ([(1, "s", "a", 1, "x"), (1, "s", "b", 1, "x")], [(None,) * 5] * 4):
        same(merkle.digests(table(spark, rows)).collect(), plain_manifest(rows))


def test_ranks_by_bitmap(spark):
    rng = random.Random(2)
    ids = [rng.randrange(-2**62, 2**62) for _ in range(300)] + list(range(-70, 200)) + [-2**63, 2**63 - 1]
    rows = spark.createDataFrame([(rng.choice("ab"), i, f"{i}") for i in ids], "g string, id bigint, leaf string")
    got = {(r["g"], r["id"]): (r["idx"], r["total"]) for r in merkle.coordinates(rows).collect()}
    groups = {}
    for g, i in got:
        groups.setdefault(g, []).append(i)
    assert got == {(g, i): (k, len(v)) for g, v in groups.items() for k, i in enumerate(sorted(v))}


# --- fill in the middle -----------------------------------------------------------

def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark, monkeypatch):
    rng = random.Random(1)
    made = ["", None, "a", " ", "<P>", "x <S> y", "<<M>", "<P", "P>", "<S<S", "漢字🙂é", "ab12 cd\n\n\x00ef", "é" * 40, "word " * 60]
    made += ["".join(rng.choice("ab<>PSM é\n漢") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    made.append("".join(rng.choice(["lorem ", "é", "漢", "<", "🙂 ", "ipsum"]) for _ in range(100_000)))
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(made)] + [(None, "s", "en", 1, "null id here"), (3, "s", "en", 1, " "), (3, "s", "en", 1, " ")]
    want = [plain_middle(r[0], r[4]) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    same(middle_fill.digests(table(spark, rows)).collect(), want)
    outputs = middle_fill.transform(table(spark, rows))
    back = middle_fill.restored(outputs)
    same(back.select("doc_id", "restored").collect(), [(r[0], r[4] or "") for r in rows])
    assert middle_fill.digests(table(spark, [])).count() == 0


def test_rotations_undo_each_other(monkeypatch):
    rng = random.Random(6)
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(middle_fill, "BLOCK", block)
        for _ in range(60):
            text = "".join(rng.choice("ab é漢1") for _ in range(rng.randint(0, 40))).encode()
            units = middle_fill.Units(text)
            found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())
            assert len(units) == len(found)
            places = [len("".join(found[:i]).encode()) for i in range(len(found) + 1)]
            assert [units.place(i) for i in range(len(found) + 1)] == places
            a, b = sorted(rng.choice(places) for _ in range(2))
            assert units.code_points(a, b) == len(text[a:b].decode())
            for form in ("psm", "spm"):
                assert middle_fill.restored_text(bytes(middle_fill.shuffled(text, a, b, form)), form) == text
            view = np.frombuffer(bytearray(text), dtype=np.uint8)
            middle_fill.rotate(view, 0, a, len(text))
            assert view.tobytes() == text[a:] + text[:a]


# --- personal data ----------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CARD = "4111 1111 1111 1111"


def texts():
    rng = random.Random(8)
    made = [None, "", " ", "a@b.c", "a@b.c_d@e.f", "..a@b-.c.d.e@f.g@h", "é a.b+c%d@x-y.z é", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.2.3 0001.02.3.255", "256.1.1.1",
            CARD, f"x{CARD}y", CARD.replace(" ", "-"), "4111 1111 1111 1112", "1 2 3 4 5 6 7 8 9 0 1 2", "+1 (425) 555-0153", "+1 2", "+12 34567", "++49 30.1234-5678)",
            f"漢 a@b.cc, 1.2.3.4; +1 (425) 555-0153 {CARD} 10.0.0.1", "\U0001F642" * 5 + " q@w.er"]
    made += ["".join(rng.choice(["a", "@", ".", "1", "23", " ", "-", "+", "4", "(", ")", "é", "_", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    made.append(" ".join(rng.choice(["a@b.co", "10.1.2.3", CARD, "+1 (425) 555-0153", "word", "漢字"]) for _ in range(3000)))
    return made


def test_fixed_forms(spark):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(texts())] + [(None, "s", "en", 1, "n@u.ll"), (7, "s", "en", 1, "1.2.3.4"), (7, "s", "en", 1, "1.2.3.4")]
    got = pii.digests(table(spark, rows)).collect()
    want = []
    for r in rows:
        spans = plain_spans(r[4])
        want.append((r[0], *[sum(k == rank for _, k, _ in spans) for rank in range(4)], sha(listed(spans))))
    same([tuple(g)[:6] for g in got], want)
    for g in got:
        assert len([x for x in g["spans"].split(",") if x]) == sum(tuple(g)[1:5]) + g["n_added"]
    assert pii.digests(table(spark, [])).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, "s", "en", 1, text))
        n += 1
        return n - 1

    for i in range(60):
        add(f"please ring hotline: +1 (425) 555-01{i:02d} today and tomorrow")
        add(f"write to mailbox: user{i}@host{i}.example.org whenever you like")
        add(f"in the year {1990 + i} there were {i + 3} of them, see page 4{i}.")
    phone = add("please ring hotline: 425 555 7788 today or never")
    mail = add("write to mailbox: jane(at)example.org whenever")
    # a value found by one pattern lends trust to another
    for i in range(8):
        add(f"please ring hotline: 206 555 90{i:02d} now")
        add(f"or desk no. 206 555 90{i:02d} at night")
    second = add("or desk no. 360 555 1234 at noon")
    clean = [add("in the year 2020 nothing of 12345678 happened"), add("hotline: none at all"), add(f"ring hotline: {'9' * 40} is no number")]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    text = {r[0]: r[4] for r in rows}

    def found(i):
        return [(k, text[i][int(a):int(b)]) for k, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]

    assert found(phone) == [("phone", "425 555 7788")] and got[phone]["n_phone"] == 0
    assert found(mail) == [("email", "jane(at)example.org")]
    assert found(second) == [("phone", "360 555 1234")]
    assert all(not got[i]["spans"] for i in clean)
    # base spans stay, whatever the patterns say
    assert all(got[i]["n_phone"] + got[i]["n_email"] == 1 for i in range(180) if i % 3 != 2)
    one_round = {r["doc_id"]: r["added"] for r in pii.spans(docs, rounds=1).collect()}
    assert len(one_round[phone]) == 1 and one_round[second] == []


def test_long_texts_take_linear_time(spark):
    n = 300_000
    made = ["a" * n, "1" * n, "a." * n, "a@" * n, "1." * n, "1 " * n, "1 2x " * n, "+1" * n, "a@b." + "c." * n, "(" * n, "+1 " + "(" * n, "x" * n + "@b.c",
            " ".join(["10.0.0.1"] * 30_000)]
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(made)]
    started = time.time()
    got = {r["doc_id"]: r for r in pii.digests(table(spark, rows)).collect()}
    assert time.time() - started < 90
    assert got[11]["n_email"] == 1 and got[12]["n_ip"] == 30_000
    assert got[12]["base_sha256"] == sha(listed([(9 * i, 1, 9 * i + 8) for i in range(30_000)]))


# --- the registered queries -------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = awkward(80) + [(10_000 + i, "src", "en", len(t or ""), t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{out}/documents.parquet")
    return out, rows


def test_queries_equal_brute_force(spark, folder):
    out, rows = folder
    same(queries.op11_merkle_manifest(spark, out).collect(), plain_manifest(rows))
    same(queries.op12_fill_in_middle(spark, out).collect(), [plain_middle(r[0], r[4]) for r in rows])
    got = queries.op13_pii(spark, out).select("doc_id", "base_sha256").collect()
    same(got, [(r[0], sha(listed(plain_spans(r[4])))) for r in rows])
