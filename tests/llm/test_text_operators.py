"""The text operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows,
clashing column names and empty tables."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash

from vectide.llm import (
    bpe, decontaminate, licenses, linededup, nndescent, pii, quality, secretscan, simhash, substrings,
)
from vectide.llm.components import components
from vectide.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, chunk long, fp string, n long, place int"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x", 1, 2) for i, t in zip(ids, texts)], SCHEMA)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    base = [" ".join(word() for _ in range(150)) for _ in range(6)]
    texts = [None, "", " \t\n", "One two three", "one TWO three", "word " * 300, "\n".join(["same line"] * 9)]
    for _ in range(n):
        words = rnd.choice(base).split()
        a, b = sorted(rnd.sample(range(151), 2))
        part = words[a:b] + [word() for _ in range(rnd.randint(0, 20))]
        texts.append(rnd.choice([" ", "  ", "\n", "\x0b"]).join(part) if rnd.random() < 0.5 else
                     "\n".join(" ".join(part[i:i + 8]) for i in range(0, len(part), 8)))
    return texts + [texts[-1], base[0], base[0] + "!", " ".join(word() for _ in range(5000))]


def test_simhash_groups(spark):
    texts = corpus()
    rows = simhash.near_duplicates(frame(spark, texts)).collect()

    def brute(text):
        words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]
        if not words:
            return 0
        size = min(4, len(words))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [brute(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}


def test_covering_masks_miss_no_pair():
    rnd = random.Random(3)
    for bits in (list(range(64)), rnd.sample(range(64), 31), rnd.sample(range(64), 9)):
        masks = simhash.covering_masks(bits, 4)
        assert all(masks)
        for _ in range(3000):
            flips = sum(1 << b for b in rnd.sample(bits, rnd.randint(1, 4)))
            assert any(not mask & flips for mask in masks)


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(5)
    near = {0}
    while len(near) < 400:  # many fingerprints within few bits of each other
        near.add(rnd.choice(sorted(near)) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    near |= {rnd.getrandbits(63) for _ in range(50)}
    prints = sorted(near)
    links = simhash.near_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"), bucket=16)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    root = {p - (1 << 64) if p >> 63 else p: None for p in prints}
    order = sorted(root)
    found = {p: p for p in order}
    changed = True
    values = np.array(order, np.int64)
    near_pairs = np.argwhere(np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 4)
    while changed:
        changed = False
        for i, j in near_pairs:
            low = min(found[order[i]], found[order[j]])
            if found[order[i]] != low or found[order[j]] != low:
                found[order[i]] = found[order[j]] = low
                changed = True
    assert {p: got.get(p, p) for p in order} == found


def test_keep_one_document_of_each_group(spark):
    texts = ["a b c d e f", "a b c d e f", "g h i j k l", None, "", "m n o p q r", "m n o p q r"]
    ids = [4, 2, 3, 5, 6, 8, 8]
    rows = simhash.keep_one(frame(spark, texts, ids)).collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 3, 5, 8] and rows[0].asDict().keys() == {
        "doc_id", "text", "chunk", "fp", "n", "place"}


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (7, 7)], "a long, b long")
    assert {r["root"] for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("group", [200_000, 5])
def test_repeated_passages(spark, group):
    texts = corpus(2, 80)
    df = frame(spark, texts).unionByName(frame(spark, [texts[20], texts[20]], [None, 20])).repartition(5, "doc_id")
    rows = substrings.repeat_digests(df, group=group, chunk_bytes=4000).collect()
    first, want = {}, {}
    for i, text in enumerate(texts):
        words = [w for w in re.split("[ \t-\r]+", text or "") if w]
        gone = set()
        for s in range(len(words) - 49):
            if first.setdefault(tuple(words[s:s + 50]), i) < i:
                gone.update(range(s, s + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert len(rows) == len(texts) + 2
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]


def test_benchmark_passages(spark):
    texts = corpus(3)
    items = [None, "", "..!", "one", "Two, THREE", texts[30], texts[31][:200], texts[30]]
    bench = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, item in enumerate(items):
        words = find((item or "").translate(LOWER))
        for s in range(len(words) - min(10, len(words)) + 1 if words else 0):
            windows.setdefault(tuple(words[s:s + 10]), set()).update({str(i)} - {"4"})
    for i, text in enumerate(texts):
        words, hit, found = find((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if tuple(words[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(words[s:s + n])]
        assert got[i] == (len(words), len(hit), sorted(found)), i
    none = decontaminate.contamination(frame(spark, texts), bench.limit(0))
    assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.keep_clean(frame(spark, texts), bench).count() == sum(not got[i][1] for i in got)


def brute_lines(texts, min_words=1):
    """(text, lines removed) of each text, in the order of the documents."""
    seen, out = {}, []
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        full = [len([w for w in re.split("[ \t-\r]+", x) if w]) >= min_words for x in lines]
        gone = set()
        for i, line in enumerate(lines):
            if not any(full):
                break
            if full[i]:
                key, at = ("line", line), i
            else:  # the stretch of other lines around i, with the full line before it or, at the head, behind it
                a = b = i
                while a > 0 and not full[a - 1]:
                    a -= 1
                while b + 1 < len(lines) and not full[b + 1]:
                    b += 1
                key, at = (("tail", *lines[a - 1:b + 1]) if a else ("head", *lines[:b + 2])), a
            if seen.setdefault(key, (d, at)) != (d, at):
                gone.add(i)
        out.append((text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


@pytest.mark.parametrize("min_words", [1, 3])
def test_repeated_lines(spark, min_words):
    rnd = random.Random(6)
    some = ["", " ", "\t", "a", "b c", "d e f", "one two three four", "x y z", "\r", "é ü ñ"]
    texts = corpus(4) + ["a\nb", "a\nb", "\n\n", "\n\na\n\nnew", "\n\na\n\n"] + [
        "\n".join(rnd.choice(some + [f"only {rnd.random()} here"]) for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(frame(spark, texts), min_words=min_words).collect()}
    assert got == dict(enumerate(brute_lines(texts, min_words)))


def test_line_counts_leave_columns_of_the_user_alone(spark):
    df = spark.createDataFrame([(3, "a\nb", 99, "mine", 1), (4, "a\nb\nc", 98, "too", 2), (4, "a\nb\nc", 98, "too", 2), (None, "a", 1, "x", 3),
                                (5, None, 0, "y", 4)], "doc_id long, text string, n_lines long, n_removed string, gone int")
    got = sorted(linededup.dedup_lines(df).collect(), key=str)
    assert linededup.count_columns(df) == ("_n_lines", "_n_removed")
    assert [tuple(r) for r in got] == sorted([
        (3, "a\nb", 99, "mine", 1, 2, 0), (4, "c", 98, "too", 2, 3, 2), (4, "c", 98, "too", 2, 3, 2), (None, "a", 1, "x", 3, 1, 0),
        (5, None, 0, "y", 4, 1, 0)], key=lambda r: str(spark.createDataFrame([r], linededup.dedup_lines(df).schema).first()))


def test_time_of_repeated_lines_is_linear(spark):
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        start = time.time()
        assert {r["n_removed"] for r in linededup.dedup_lines(df).collect()} == {0, n}
        return time.time() - start

    seconds(1000)
    assert seconds(80_000) < 3 * seconds(40_000) + 2


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = corpus(6) + ["<|endoftext|>a <|startoftext|>", "İI ΣΑΣ ﬁ it's 12a3", "e ́ \x1c \x85 　z", "🙂 a\x00b"]
    df = frame(spark, texts).unionByName(frame(spark, ["again"], [None]))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = bpe.encode(df, tokenizer_path(), chunk_bytes=3000).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        text = "again" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(frame(spark, ["", None, " "]), tokenizer_path()).filter("size(ids) > 0 or decoded <> ''").count() == 0


def test_secret_patterns_and_network(spark):
    rnd = random.Random(8)
    token = lambda n, letters="abcdef0123456789": "".join(rnd.choice(letters) for _ in range(n))
    texts = [None, "", "no secrets", "tokenſecret=abcdefgh1", "ToKeN : \"abc.def=12345678\" AKIA" + "A" * 12, "AKIA12"]
    for _ in range(120):
        texts.append(f"é some words password={token(18)} and {token(40)} host{rnd.randint(1, 99)}.example.com 10.20.30.{rnd.randint(1, 99)}")
    kinds = [("assign", re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
                                   r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"), 8),
             ("access", re.compile("(AKIA[A-Z0-9]+)"), 16), ("hex", re.compile("([0-9a-f]+)"), 32)]
    rows = secretscan.scan(frame(spark, texts)).collect()
    for row in rows:
        spans = sorted(((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, n) in enumerate(kinds)
                        for m in p.finditer(texts[row["doc_id"]] or "") if len(m[1]) >= n))
        assert row["base_sha256"] == hashlib.sha256(",".join(s for _, _, s in spans).encode()).hexdigest()
        assert set(s for _, _, s in spans) <= set(row["spans"].split(","))
    net = secretscan.fit([b"x" * 30 + token(42).encode() for _ in range(200)] + [b"x" * 30 + token(42, "ghijklm").encode() for _ in range(200)],
                         [1] * 200 + [0] * 200)
    fresh = [b"x" * 30 + token(42).encode() for _ in range(100)], [b"x" * 30 + token(42, "ghijklm").encode() for _ in range(100)]
    assert (net.probabilities(fresh[0]) >= net.threshold).mean() > 0.9 > 0.1 > (net.probabilities(fresh[1]) >= net.threshold).mean()


def _keyed_texts(rnd, n=500):
    """Texts with a key of letters only at the end of a long address, and addresses without one; the places of the keys."""
    key = lambda: "".join(rnd.choice("QZXWVKJ") for _ in range(24))
    plain = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(24))
    texts, found = [], []
    for i in range(n):
        lead, secret = f"see //hooks.example.com/services/T{plain()[:8]}/B{plain()[:8]}/", i % 3 == 0
        texts.append(f"{lead}{key() if secret else plain()} and {plain()} too")
        if secret:
            found.append((i, len(lead), len(lead) + 24))
    return texts, found


def test_network_learns_findings_anywhere_in_a_candidate(spark):
    """Keys beyond the first window and without a digit, labelled by findings that no pattern gives."""
    texts, found = _keyed_texts(random.Random(9))
    findings = spark.createDataFrame([(*f, "x") for f in found] + [(None, 1, 2, "y"), (5, None, 3, "z")], "doc_id long, start int, `end` int, text string")
    assert all(start >= 47 for _, start, _ in found)
    net = secretscan.train(frame(spark, texts), findings=findings)
    fresh, keys = _keyed_texts(random.Random(10))
    rows = {r["doc_id"]: r["spans"] for r in secretscan.scan(frame(spark, fresh), network=net).collect()}
    hit = {i for i, spans in rows.items() if any(s.startswith("model:4:") for s in spans.split(","))}
    assert len(hit & {i for i, _, _ in keys}) > 0.9 * len(keys) and len(hit - {i for i, _, _ in keys}) < 0.1 * len(fresh)


def test_chances_are_reliable_on_held_out_rows():
    """Among windows with the true share of secrets, those with a chance near p are secrets in about a share of p."""
    rnd = np.random.default_rng(4)
    labels = (rnd.random(60_000) < 0.02).astype(float)
    scores = rnd.normal(size=len(labels)) + 2.5 * labels
    picked = np.concatenate([np.flatnonzero(labels == 1)[:500], np.flatnonzero(labels == 0)[:500]])
    scale, offset = secretscan.calibrate(scores[picked], labels[picked], 0.02)
    held = np.setdiff1d(np.arange(len(labels)), picked)
    chance = 1 / (1 + np.exp(-(scale * scores[held] + offset)))
    assert abs(chance.mean() - labels[held].mean()) < 0.005
    for low, high in ((0.0, 0.01), (0.01, 0.1), (0.1, 0.5), (0.5, 1.0)):
        part = (chance >= low) & (chance < high)
        assert abs(chance[part].mean() - labels[held][part].mean()) < 0.08


def test_windows_hold_all_of_a_candidate():
    for a, b in ((0, 12), (5, 53), (5, 54), (100, 5000)):
        seen = set()
        for s in secretscan.places(a, b):
            seen |= set(range(s - secretscan.BEFORE, s - secretscan.BEFORE + secretscan.WIDTH))
        assert set(range(a - secretscan.BEFORE, b + secretscan.BEHIND)) <= seen
    text = "é\0" + "k" * 100
    for s in (0, 1, 60, 101):
        data = secretscan.window(text, s)
        want = [0 if i < 0 or i >= len(text) else ord(text[i]) if 0 < ord(text[i]) < 128 else 1 for i in range(s - secretscan.BEFORE, s - secretscan.BEFORE + secretscan.WIDTH)]
        assert list(data) == want


def test_many_findings_in_one_text_take_linear_time():
    def seconds(n):
        text = " ".join(f"{i:032x}" for i in range(n))
        start = time.time()
        base, free, windows = secretscan._windows(text, None)
        assert len(base) == n and not free and all(label for _, label in windows)
        return time.time() - start

    seconds(100)
    assert seconds(20_000) < 3.5 * seconds(10_000) + 0.5
    spans = secretscan.Spans([(0, 100), (5, 7), (200, 220)])
    assert [spans.meets(*x) for x in ((99, 101), (100, 200), (219, 300), (220, 230))] == [True, False, True, False]
    assert [spans.shows(*x) for x in ((95, 101), (90, 101), (210, 300), (215, 300), (4, 8))] == [False, True, True, False, True]


def test_license_alignment(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    texts = [None, "", "nothing here", "é intro. " + notice + " more words", "licensed UNDER the new apache license version 2.0 point",
             "the version of apache " * 50, notice + "\n" + "Released under the MIT License.", "word " * 5000 + notice]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [rows[i]["licenses"] for i in range(8)] == ["", "", "", "Apache-2.0", "Apache-2.0", "", "Apache-2.0,MIT", "Apache-2.0"]
    name, start, end, share = rows[3]["spans"].split(":")
    assert texts[3][int(start):int(end)] == notice and share == "1.0"
    assert licenses.align("a b c d e".split(), "x b d y e".split()) == [(1, 1), (3, 2), (4, 4)]


def _plain(text):
    return text.replace("{", "").replace("}", "")


def test_license_names_are_right_or_missing():
    find = licenses.Scanner(licenses.standard_templates(), licenses.COVERAGE).find
    names = lambda text: [h[0] for h in find(text)]
    for text in ("Released under the BSD License", "Released under the GPL License", "GNU General Public License, version 2",
                 "The MIT License is short", "licensed under the terms of nothing", "published by the author under 4.0"):
        assert names(text) == [], text
    for kind in licenses.CC_KINDS:
        for version in licenses.CC_VERSIONS:
            spelt = "-".join(licenses.CC_TERMS[p] for p in kind.split("-"))
            assert names(f"Licensed under CC {kind} {version}.") == [f"CC-{kind}-{version}"]
            assert names(f"This work is licensed under a Creative Commons {spelt} {version} International License") == [f"CC-{kind}-{version}"]
    for name, text in licenses.NOTICES + licenses.TEXTS:
        lines = "\n * ".join(_plain(text).upper().split(" "))
        assert names(f"/* {lines} */ int x;") == [name], text[:60]
    assert names("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nMIT") == [
        "MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0"]


@pytest.mark.parametrize("copies", [2, 3, 4, 6])
def test_adjacent_notices_are_all_found(copies):
    find = licenses.Scanner(licenses.standard_templates(), licenses.COVERAGE).find
    for name, notice in (("MIT", "Released under the MIT License. "), ("MIT", "Released today under the MIT License. "),
                         ("BSD-2-Clause", licenses.TEXTS[2][1] + " "), ("GPL-3.0", _plain(licenses.NOTICES[2][1]) + " ")):
        found = find("foo bar baz " + notice * copies + "end of it")
        assert [h[0] for h in found] == [name] * copies, notice[:40]


def _longest(a, b):
    """Length of the longest common sequence of words, by the plain dynamic programme."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_license_places_equal_all_starts_by_dynamic_programme():
    """Notices with words dropped, changed or put in, among other words, with and without words that must stand."""
    rnd = random.Random(8)
    names = [f"n{i}" for i in range(60)]
    templates = [("T1", "alpha beta gamma {delta 1 0} epsilon zeta eta theta iota kappa"),
                 ("T2", "alpha beta gamma {delta 2 0} epsilon zeta eta theta iota kappa"),
                 ("T3", "one two three four five six seven eight nine ten eleven twelve")]
    find = licenses.Scanner(templates, 0.8).find
    parsed = [licenses.Template.parse(*t) for t in templates]
    for _ in range(250):
        text = []
        for _ in range(rnd.randint(1, 4)):
            text += [rnd.choice(names) for _ in range(rnd.randint(15, 25))]
            planted = list(rnd.choice(parsed).words)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(planted))
                planted[at:at + 1] = rnd.choice([[], [rnd.choice(names)], [planted[at], rnd.choice(names)]])
            text += planted
        text += [rnd.choice(names) for _ in range(15)]
        want = []
        for t in parsed:
            m = len(t.words)
            phrase = t.words[slice(*t.phrases[0])] if t.phrases else ()
            for s in range(0, len(text), 1):
                part = text[s:s + m + 3]
                stands = not phrase or any(tuple(part[i:i + len(phrase)]) == phrase for i in range(len(part)))
                if part and part[0] in t.words and stands and _longest(part, t.words) >= 0.8 * m:
                    want.append((t.name, s))
        # starts a few words apart are one place
        places = [w for n, w in enumerate(sorted(want, key=lambda w: w[1])) if n == 0 or w[1] - sorted(want, key=lambda w: w[1])[n - 1][1] > 6]
        got = find(" ".join(text))
        assert [h[0] for h in got] == [w[0] for w in places], " ".join(text)


def test_personal_data(spark):
    texts = [None, "", "plain", "mail a.b@c.d.e and +1 (212) 555-1234", "card 4111 1111 1111 1111 ip 1.2.3.4.5.6.7.8 256.1.1.1",
             "+12 345 6789 x+1 23", "1" * 5000, "a@b c@d.e+f@g.h", "٣٤ 4111-1111-1111-1112"] + [
             f"é call +1 (212) 555-{n} or n{n}@m.org at 10.0.0.{n % 256}" for n in range(1000, 1060)]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15)]
    for row in pii.scan(frame(spark, texts)).collect():
        spans = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds)
                       for m in re.finditer(p, texts[row["doc_id"]] or "") if ok(m[0]))
        assert row["base_sha256"] == hashlib.sha256(",".join(s for _, _, s in spans).encode()).hexdigest(), row
        assert [row[f"n_{k}"] for k, _, _ in kinds] == [sum(s[1] == i for s in spans) for i in range(4)]


def test_repeats_share_a_label():
    """The second mention alone would be O; the skip edge carries the label of the first one over."""
    c = pii.chain("call +15551234567 now and much later again 15551234567 there")
    field = pii.Field(np.zeros((pii.BUCKETS, 5)), np.zeros((5, 5)), 3 * np.eye(5))
    first = [i for i, f in enumerate(c.features) if pii._bucket("+True") in f][0]
    field.unary[pii._bucket("+True"), 4] = 4.0
    field.unary[pii._bucket("+False"), 0] = 1.0
    best = field.beliefs(c).argmax(axis=1)
    second = [int(b) for a, b in c.edges[c.skip]][0]
    assert best[first] == best[second] == 4 and (best == 4).sum() == 2


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts, rows = [], []
    for i in range(900):
        words, kind = [word() for _ in range(rnd.randint(20, 80))], i % 3
        if kind == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["scum", "idiot"])
        if kind == 1:
            words = [words[0]] * 30 + ["!!!"] * 9
        texts.append(" ".join(words))
        rows.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    rows += [(None, 1, 0), (3, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts + [None, ""], [*range(900), 900, 901])
    model = quality.train(docs, labels.filter("doc_id < 600 or doc_id is null"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
    assert np.mean([got[i]["selected"] == (i % 3 == 2) for i in range(600, 900)]) > 0.95
    assert got[900]["expected_grade"] == got[901]["expected_grade"]
    kept = quality.keep_selected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["selected"] for r in got.values())
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert quality.keep_selected(docs, empty).count() == 902


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2):
        for size, noise in ((300, 0.02), (40, 0.12), (1, 0)) + ((1, 0),) * 30:
            centre = rng.normal(size=16)
            for _ in range(size):
                rows.append((n, (centre + noise * np.linalg.norm(centre) / 4 * rng.normal(size=16)).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 15 + [float("nan")], 1), (n + 3, None, 1),
             (n + 4, rows[0][1], None), (n + 5, [], 2), (None, rows[0][1], 1), (n + 6, [1.0, None], 1), (n + 7, rows[0][1][:8], 1)]
    df = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, node int")
    got = {r["vec_id"]: r for r in nndescent.near_duplicates(df, block=64).collect()}
    good = [(i, np.array(v), label) for i, v, label in rows
            if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in rows if i is not None}, {i: 0 for i, *_ in rows if i is not None}
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    for a, _ in pairs:
        links[a] += 1
    for _ in range(6):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert sum(got[i]["n_links"] for i in links) >= 0.97 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in links)
    assert np.mean([got[i]["component_id"] == root[i] for i in root]) > 0.97
    assert got[None]["kept"] is False and got[None]["n_links"] == 0
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [
    simhash.near_duplicates, simhash.keep_one, substrings.repeats, linededup.dedup_lines, licenses.scan, pii.scan,
    secretscan.scan, lambda d: bpe.encode(d, tokenizer_path()),
    lambda d: decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text"))])
def test_empty_tables(spark, run):
    assert run(frame(spark, ["a"]).filter("doc_id < 0")).count() == 0


def test_pii_sample_is_the_first_by_hash(spark, monkeypatch):
    """Different texts, also where copies leave a gap in the hashes, with fewer rows than asked for and beyond the bytes."""
    rows = [(i, [], f"text {i % 40 if i < 600 else i}") for i in range(1000)] + [(None, [], None), (7, [], "long " * 1000)]
    found = spark.createDataFrame(rows, "doc_id long, base array<struct<kind:string,start:long,end:long>>, text string").repartition(7)
    monkeypatch.setattr(pii, "LONGEST", 1000)
    whole = [r["text"] for r in found.filter("length(text) < 1000").selectExpr("xxhash64(text) AS h", "text").distinct().orderBy("h", "text").collect()]
    for n in (1, 5, 90, 700, 2000):
        got = pii._first_by_hash(found, n)
        assert [r["text"] for r in got] == whole[:n]
        assert all(rows[r["doc_id"]][2] == r["text"] for r in got)
    monkeypatch.setattr(pii, "SAMPLE_BYTES", 100)
    some = [r["text"] for r in pii._first_by_hash(found, 90)]
    assert some == whole[:len(some)] and 85 < sum(map(len, some)) <= 100
    assert pii._first_by_hash(found.limit(0), 5) == []


def _enumerated(c, field):
    """Marginal of each token over all labellings."""
    n, k = len(c.features), len(pii.LABELS)
    local = np.stack([field.unary[f].sum(axis=0) for f in c.features])
    sums = np.zeros((n, k))
    for code in range(k ** n):
        y = [code // k ** i % k for i in range(n)]
        score = sum(local[i, y[i]] for i in range(n)) + sum(
            (field.skip if far else field.step)[y[a], y[b]] for (a, b), far in zip(c.edges.tolist(), c.skip.tolist()))
        for i in range(n):
            sums[i, y[i]] += np.exp(score)
    return sums / sums.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("edges,exact", [
    ([(0, 1), (1, 2), (2, 3)], True), ([(0, 1), (0, 2), (0, 3)], True), ([(0, 1), (1, 2), (0, 2)], False),
    ([(0, 1), (1, 2), (2, 3), (0, 3)], False), ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], False)])
def test_beliefs_against_exact_enumeration(edges, exact):
    rnd = np.random.default_rng(len(edges))
    n, k = 1 + max(b for _, b in edges), len(pii.LABELS)
    for _ in range(5):
        field = pii.Field(rnd.normal(0, 1, (pii.BUCKETS, k)), rnd.normal(0, 0.4, (k, k)), np.eye(k))
        c = pii.Chain([(2 * i, 2 * i + 1) for i in range(n)], [np.array([i]) for i in range(n)], [], np.array(edges), rnd.random(len(edges)) < 0.5)
        found = field.beliefs(c, 200)
        found = np.exp(found - found.max(axis=1, keepdims=True))
        found /= found.sum(axis=1, keepdims=True)
        want = _enumerated(c, field)
        assert np.abs(found - want).max() < (0.01 if exact else 0.15)
        assert np.abs(found - want).mean() < (0.005 if exact else 0.03)


def test_field_learns_labels_that_no_pattern_gives(spark):
    """Numbers after a word are telephone numbers, the same numbers after another word are not."""
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        number = f"{rnd.randint(200, 999)} {rnd.randint(1000, 9999)}" if i % 4 else str(rnd.randint(2000000, 9999999))
        text = f"please {'call' if i % 2 else 'count'} {number} today or never"
        texts.append(text)
        if i % 2:
            at = text.index(number)
            labels.append((i, "phone", at, at + len(number)))
    given = spark.createDataFrame(labels + [(None, "phone", 0, 1), (3, "other", 0, 2)], "doc_id long, kind string, start long, `end` long")
    df = frame(spark, texts)
    field = pii.train(df.filter("doc_id < 200").select("doc_id", "text").mapInArrow(pii._find, pii._FOUND), labels=given)
    held = {r["doc_id"]: r["spans"] for r in pii.scan(df.filter("doc_id >= 200"), field=field).collect()}
    assert sum(("crf_phone" in spans) == (i % 2 == 1) for i, spans in held.items()) > 0.9 * len(held)


def test_labels_and_overlaps_in_one_long_text_take_linear_time():
    def seconds(n):
        text = " ".join(f"+1 212 555 {i % 9000 + 1000} x" for i in range(n))
        start = time.time()
        base = pii.base_spans(text)
        c = pii.chain(text)
        y = pii.gold(c, base)
        assert len(base) == n and (y > 0).sum() == 4 * n
        pii.added_spans(c, pii.fit([], []), base)
        return time.time() - start

    seconds(100)
    assert seconds(8000) < 3.5 * seconds(4000) + 0.5


def test_lines_are_winnowed_and_runs_extended(spark):
    """Fingerprints are the least hashes of windows; runs of a window's length are found by them, other lines by the check."""
    rnd = random.Random(8)
    hashes = [[rnd.choice([-5, 1, 2, 3, 9, 40]) for _ in range(rnd.randint(1, 30))] for _ in range(60)]
    marked = spark.createDataFrame([(d, 0, [(h, 0, 1) for h in hs]) for d, hs in enumerate(hashes)],
                                   "doc_id long, text_key long, prints array<struct<high:long,low:int,lines:long>>")
    w = linededup.WINDOW
    assert w > 1
    for row in marked.withColumn("chosen", linededup._winnowed("prints")).collect():
        hs = hashes[row["doc_id"]]
        starts = range(max(len(hs) - w, 0) + 1)
        assert row["chosen"] == sorted({min(range(s, min(s + w, len(hs))), key=lambda i: (hs[i], -i)) for s in starts})
    run = [rnd.getrandbits(60) for _ in range(25)]
    texts = [[1, *run, 2], [3, 4, *run[3:20], 5], [6, run[9], 7]]
    marked = spark.createDataFrame([(d, 0, [(h, 0, 1) for h in hs]) for d, hs in enumerate(texts)], marked.schema)
    found = {(r["doc_id"], r["at"]) for r in linededup._matched_pieces(marked).collect()}
    assert {p for p in found if p[0] == 1} == {(1, i) for i in range(2, 19)} and not any(d == 0 for d, _ in found)
