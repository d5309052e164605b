"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
import zlib

import pytest

from vectide.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, g string, pos long, n long, h string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def climb(cur, at, tree):
    proof = ""
    for nodes in tree[:-1]:
        run = nodes[at // 2 * 2:at // 2 * 2 + 2]
        proof += "".join(h for n, h in enumerate(run) if n != at % 2)
        cur = sha(*[cur if n == at % 2 else h for n, h in enumerate(run)])
        at //= 2
    return cur, proof


def brute(rows):
    """rows of (doc_id, text, source, lang, n_chars)."""
    groups = {}
    for doc_id, text, source, lang, n in rows:
        leaf = framed(doc_id, source, lang, n, text)
        tampered = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id, leaf, framed(doc_id, source, lang, n + 1, text) if tampered else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels([leaf for _, leaf, _ in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for n, (doc_id, leaf, start) in enumerate(groups[lang]):
            cur, low = climb(start, n, trees[lang])
            cur, high = climb(cur, at, top)
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], sha(low, high), cur, cur == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4, "y") for r in rows], SCHEMA)


def rows(sizes, seed=1):
    rnd = random.Random(seed)
    out = []
    for lang, size in sizes.items():
        for _ in range(size):
            text = rnd.choice([None, "", "é\n" * 5, "word " * rnd.randint(1, 9)])
            out.append((rnd.randint(0, 4000), text, rnd.choice([None, "src"]), lang, rnd.choice([None, 5, 1234])))
    rnd.shuffle(out)
    return out + [(None, "no id", None, "en", 3), (None, "no id", None, "en", 3)] + out[:3] + [(77, "big " * 300_000, "s", "en", 9)]


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_equals_brute_force(spark, block):
    data = rows({"en": 37, None: 5, "": 1, "zh": 2, "é": 8, "f": 1})
    got = [tuple(r) for r in merkle.manifest(frame(spark, data), block).collect()]
    want = brute(data)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 8, 9, 2100])
def test_one_group_of_any_size(spark, size):
    data = [(i, f"text {i}", "s", "en", i) for i in range(size)]
    got = [tuple(r) for r in merkle.manifest(frame(spark, data)).collect()]
    assert sorted(got) == sorted(brute(data))


def test_many_copies_of_one_row_are_spread(spark):
    data = [(5, "same", "s", "en", 4)] * 3000 + [(i, "x", "s", "de", 1) for i in range(50)]
    placed = merkle.numbered(frame(spark, data).select("lang", "doc_id", "text"), "lang", ["doc_id"])
    assert sorted((r["lang"], r["pos"], r["n"]) for r in placed.collect()) == [
        ("de", i, 50) for i in range(50)] + [("en", i, 3000) for i in range(3000)]
    got = [tuple(r) for r in merkle.manifest(frame(spark, data)).collect()]
    assert sorted(got) == sorted(brute(data))
