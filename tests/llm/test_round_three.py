"""Whitening, byte-pair encoding and conversation repair against plain versions, on odd rows and on rows that break off."""

from __future__ import annotations

import hashlib
import json
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import bpe, queries, repair, whitening

tokenizers = pytest.importorskip("tokenizers")
VECTORS = "k string, vec_id long, embedding array<double>, n int, y string"


def plain_whitening(rows):
    """(vec_id, component) to (n, deviation, whitened but for its sign, explained) by Python integers and numpy."""
    whole = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in whole:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        row = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out += [(i, k + 1, n, dev, float(row @ u[:, k] / np.sqrt(e[k])), float(e[k] / e.sum())) for k in range(min(16, d))]
    return out


def test_whitening_is_that_of_the_plain_version(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(90, 20)) * np.arange(1, 21))]
    rows += [(200, rows[5][1]), (200, rows[5][1]), (201, rows[7][1]), (None, rows[8][1]), (202, None), (203, [None] + rows[1][1][1:]), (204, [float("inf")] + rows[1][1][1:]), (205, [float("nan")] * 20)]
    frame = spark.createDataFrame([("x", i, v, 1, "y") for i, v in rows], VECTORS).repartition(4)
    got = sorted(whitening.whitening(frame).collect(), key=lambda x: (x.vec_id is None, x.vec_id or 0, x.component))
    want = sorted(plain_whitening(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [(g.vec_id, g.component, g.n, g.deviation) for g in got] == [w[:4] for w in want]
    signs: dict[int, float] = {}
    for g, w in zip(got, want, strict=True):
        sign = signs.setdefault(g.component, np.sign(g.whitened * w[4]))
        assert np.isclose(g.whitened, sign * w[4], rtol=1e-9, atol=1e-9) and np.isclose(g.explained, w[5], rtol=1e-9)
    assert {g.n for g in got} == {90} and max(g.identity_error for g in got) < 1e-9


def test_scatter_is_exact_for_numbers_of_any_size():
    for bits in (3, 20, 40, 61):
        y = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (whitening.ROWS + 100, 3))
        sums, products = whitening.scatter(y)
        plain = [[int(a) for a in x] for x in y]
        assert sums.tolist() == [sum(x[j] for x in plain) for j in range(3)]
        assert products.tolist() == [[sum(x[i] * x[j] for x in plain) for j in range(3)] for i in range(3)]


def test_limbs_add_up():
    numbers = np.array([0, -1, 5, -(1 << 126), (1 << 127) - 1], object)
    limbs = whitening._limbs(numbers)
    assert [sum(int(x) << whitening.LIMB * k for k, x in enumerate(row)) for row in limbs] == numbers.tolist()


def test_whitening_of_odd_vectors(spark):
    """Huge entries, lengths that differ, vectors all alike, one vector, no entries, no rows."""
    frame = spark.createDataFrame([("x", i, v, 1, "y") for i, v in [(1, [1e300, 2.0]), (5, [1.0]), (6, [1.0]), (7, []), (8, [-1e300, 2.0]), (9, [3.0, 1.0])]], VECTORS)
    got = {(x.vec_id, x.component): x for x in whitening.whitening(frame).collect()}
    assert set(got) == {(1, 1), (1, 2), (5, 1), (6, 1), (8, 1), (8, 2), (9, 1), (9, 2)}
    assert got[1, 1].deviation is None and abs(got[1, 1].whitened) == pytest.approx(1.224744871) and got[1, 2].whitened is None
    assert got[5, 1].n == 1 and got[5, 1].whitened is None and got[5, 1].explained == 0 and got[5, 1].identity_error == 0
    assert whitening.whitening(frame.where("vec_id = 7")).count() == whitening.whitening(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.default_path())


def test_tokens_are_the_library_s(vocabulary):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    r = random.Random(1)
    texts = [
        "", "Hello's don't we'll 'ssss ''s 's's x'RE're", "a" * 1000, "<|startoftext|>x<|endoftext|>'s <|endoftext|>é<|endoftext|>́", "İstanbul ΑΣ Σ ǅ ẞ", "é ẛ̣ 한 한", "日本語123 ½²",
        "\x1c\x1d \x85   ​ ﻿ \x00", "'", "r'", "'l", "a'l b'v", "!!'s !'re", "1 22 333'd", "<|startoftext", "'s<|endoftext|>'s",
        *("".join(r.choice("ab'srtvelmd 1!<|>ȩ́İΣ각 \n") for _ in range(r.randrange(60))) for _ in range(3000)),
        *("".join(chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000), r.randrange(0x3000), r.randrange(128)])) for _ in range(40)) for _ in range(1000)),
    ]
    ids, at = bpe.Encoder(vocabulary).encode(texts)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == want.ids, texts[i]
        assert bpe.decode(got, vocabulary) == library.decode(want.ids, skip_special_tokens=False)


def test_a_task_that_forgets_words_encodes_the_same(vocabulary, monkeypatch):
    texts = [" ".join(f"{a}{b}" for b in ("th", "er", "x")) for a in "abcdefghij"]
    whole = bpe.Encoder(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "WORDS", 4)
    encoder = bpe.Encoder(vocabulary)
    assert [x for t in texts for x in encoder.encode([t])[0].tolist()] == whole


def test_long_texts_are_encoded_whole(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "é́", "it's", "́x", "日本", "12"]) for _ in range(400)), "q" * 300, None, "", "short", "short"]
    assert all("".join(bpe.parts(t or "", 50)) == (t or "") for t in texts) and len(bpe.parts(texts[0], 50)) > 5
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    rows = bpe.encode_documents(docs).collect()
    assert {x.doc_id: x.ids for x in rows} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {x.doc_id: x.text for x in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert back == {x.doc_id: x.decoded for x in rows}
    odd = spark.createDataFrame([(1, None), (2, [1, None]), (3, [-1]), (4, [10**6]), (5, [])], "doc_id long, ids array<int>")
    assert {x.doc_id: x.text for x in bpe.decode_documents(odd).collect()} == {1: None, 2: None, 3: None, 4: None, 5: ""}
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def plain_repair(rows):
    """(cost, audit) by trying all edits: rows of (initial, f, t or d)."""
    legal, best = re.compile(r"(s?(ua)+)?$"), [(3 * len(rows), "D" * len(rows))]

    def go(i, out, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if i == len(rows) and legal.match(out):
            best[0] = min(best[0], (cost, audit))
        if inserts < 3:
            for x in "ua":
                go(i, out + x, cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            initial, kind = rows[i]
            go(i + 1, out, cost + 3, audit + "D", 0)
            if kind != "d":
                go(i + 1, out + initial, cost + (kind == "t"), audit + "K", 0)
                for x in "ua":
                    go(i + 1, out + x, cost + 2 + (kind == "t"), audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_cheapest_repairs_are_those_of_all_edits():
    r, trie = random.Random(2), repair.Trie()
    for _ in range(300):
        rows = [(r.choice("ssuuuaaax"), r.choice("ffftd")) for _ in range(r.randrange(0, 6))]
        signature = "".join("d" if k == "d" else x.upper() if k == "t" else x for x, k in rows)
        path = repair.Path()
        for symbol in signature:
            path.append(symbol)
        assert trie.answer(trie.insert(signature)) == path.answer() == plain_repair(rows)


def test_layers_are_shared():
    trie = repair.Trie()
    for s in sorted(["sua", "suaua", "sud", "suauA"]):
        trie.insert(s)
    assert len(trie.layer) == 1 + len({s[:i] for s in ("sua", "suaua", "sud", "suauA") for i in range(1, len(s) + 1)})


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, again int, position int"


def messy(spark):
    r = random.Random(9)
    said = ["Yes.", "No", "", " \t", None, "Why? ", "Done!", "Yes.", "x" * 3000 + ".", "é…"]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(said)) for c in [None, *range(60)] for _ in range(r.randrange(1, 9))]
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 5}.") for t in range(40)] + [(71, -(2**62) * 2, "user", "a."), (71, 2**63 - 1, "user", "b.")]
    return spark.createDataFrame([(*x, "x", 1, 2) for x in rows], CONVERSATIONS).repartition(3)


def by_sql(frame):
    con = duckdb.connect()
    con.register("t", frame.toArrow())
    con.execute("create view conversations as select * from t")
    found = con.execute(queries.ORACLES["op13_conversation_repair"])
    names = [x[0] for x in found.description]
    return sorted((dict(zip(names, row, strict=True)) for row in found.fetchall()), key=str)


def test_repairs_are_those_of_sql(spark, monkeypatch):
    frame = messy(spark).where("conv_id is null or conv_id <> 71 ").cache()
    want = by_sql(frame)
    got = [x.asDict() for x in repair.digests(repair.repaired(repair.damaged(frame))).collect()]
    assert sorted(got, key=str) == sorted([{k: x[k] for k in got[0]} for x in want], key=str)
    monkeypatch.setattr(repair, "BLOCK", 500)
    assert sorted((x.asDict() for x in repair.digests(repair.repaired(repair.damaged(frame))).collect()), key=str) == sorted(got, key=str)
    monkeypatch.setattr(repair, "LONG", 4)  # most conversations are read twice instead of held
    monkeypatch.setattr(repair, "NODES", 10)
    assert sorted((x.asDict() for x in repair.digests(repair.repaired(repair.damaged(frame))).collect()), key=str) == sorted(got, key=str)


def test_repaired_rows_have_legal_roles(spark):
    rows = repair.repaired(repair.damaged(messy(spark))).where("position > 0").orderBy("position").collect()
    roles: dict = {}
    for x in rows:
        roles.setdefault(x.conv_id, []).append(x.role[0])
    assert len(roles) > 20 and all(re.fullmatch(r"s?(ua)+", "".join(x)) for x in roles.values())


def test_conversations_without_rows(spark):
    """Dropped rows leave zeros, an empty audit and the hash of nothing; extreme turns are held; no rows give none."""
    absent = spark.createDataFrame([(5, 1, "user", "a.", True)], "conv_id long, turn long, role string, text string, absent boolean")
    got = repair.digests(repair.repaired(absent)).first()
    assert got.asDict() == {"conv_id": 5, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert repair.digests(repair.repaired(absent.limit(0))).count() == 0
    wide = spark.createDataFrame([(71, -(2**63), "user", "a.", False), (71, 2**63 - 1, "assistant", "b.", False)], absent.schema)
    assert repair.digests(repair.repaired(wide)).first().gaps == 2**63 - 1
