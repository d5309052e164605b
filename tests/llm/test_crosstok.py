"""Cross-tokenizer alignment against a byte-by-byte brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vectide.llm import crosstok
from vectide.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, tokenizer_path

PATH_A, PATH_B = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
SCHEMA = "doc_id long, text string, chunk long, kind string, n_a long, place int, top int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "text", 1, 2, 3) for i, t in zip(ids, texts)], SCHEMA)


def texts():
    rnd = random.Random(4)
    out = [None, "", " ", "\n", "a", "  two  blanks ", "tab\tand\r\nline", "▁ mark", "x▁y", "<|endoftext|> and </s> <unk>",
           "zero\x00byte", "naïve café ñandú 日本語 👩‍👩‍👧 ﬁ é", "it's they'll we've I'M", "12345 3.14 !!! ?!",
           "word " * 400, "same text", "same text", "q" * 3000, " nbsp em", "a" + " " * 500 + "b"]
    letters = "etaoin shrdlu  ,.\n\t'é日€😀0192AZ"
    for _ in range(60):
        out.append("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400))))
    return out


def brute(docs):
    """Rows by (id, text), with links found byte by byte."""
    slow = Tokenizer.from_file(PATH_A)
    slow.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters, names = crosstok.byte_letters(), {i: t for t, i in slow.get_vocab().items()}
    rows, counts = [], Counter()
    for text in docs:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in names[i])) for i in slow.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else
                  model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []
        owner = [[n for n, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = [(a[x][0], b[y][0]) for x, y in sorted(set(zip(*owner)))]
        ends = []
        for side in (a, b):
            at, mine = 0, []
            for _, x in side:
                at += len(x)
                mine.append(at)
            ends.append(mine)
        cuts, groups, first = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for cut in cuts:
            part = []
            for n, side in enumerate((a, b)):
                last = ends[n].index(cut) + 1
                part.append(",".join(str(i) for i, _ in side[first[n]:last]))
                first[n] = last
            groups.append("|".join(part))
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
             sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
            for n_a, n_b, groups, links in rows], counts


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_alignment_equals_brute_force(spark, chunk_bytes):
    docs = texts()
    want, counts = brute(docs)
    df = frame(spark, docs).repartition(4)
    got = crosstok.align_documents(df, PATH_A, PATH_B, chunk_bytes=chunk_bytes).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(want)) and len(got) == len(docs)
    pairs = crosstok.pair_counts(df, PATH_A, PATH_B, chunk_bytes=chunk_bytes).collect()
    assert {(r["a"], r["b"]): r["count"] for r in pairs} == counts


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = ["one two", "one two", "three", None]
    want, _ = brute(docs)
    got = crosstok.align_documents(frame(spark, docs, [5, 5, None, None]), PATH_A, PATH_B).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for i, w in zip([5, 5, None, None], want))
    assert crosstok.align_documents(frame(spark, docs).limit(0), PATH_A, PATH_B).count() == 0


def test_fast_ids_are_the_library_ids():
    ids, pieces = crosstok.load_a(PATH_A)
    slow = Tokenizer.from_file(PATH_A)
    slow.encode_special_tokens = True
    for text in [t for t in texts() if t] + [" " * 300_000]:
        assert ids(text) == slow.encode(text, add_special_tokens=False).ids
        assert b"".join(pieces[i] for i in ids(text)) == text.encode()


def test_windows_do_not_change_the_alignment():
    encode_a, pieces_a = crosstok.load_a(PATH_A)
    encode_b, pieces_b = crosstok.load_b(PATH_B)
    text = "The naïve word-splitter isn't fooled by 日本語, numbers 12345 or  double  blanks."
    a, b = encode_a(" " + text), encode_b(text)
    sizes = [np.array([len(x) for x in pieces]) for pieces in (pieces_a, pieces_b)]
    key = np.array(a + [i + crosstok.SHIFT for i in b], "<u4").tobytes()
    texts, groups, link_a, link_b, window = crosstok.align([key, key], *sizes, crosstok.Names(len(pieces_a), len(pieces_b)))
    assert texts[0] == texts[1] and groups[0] == groups[1] == texts[0].count(";") + 1
    parts = [g.split("|") for g in texts[0].split(";")]
    assert [int(i) for g, _ in parts for i in g.split(",")] == a and [int(i) for _, g in parts for i in g.split(",")] == b
    assert (window == 0).sum() == (window == 1).sum() == len(a) + len(b) - groups[0]
    assert set(link_a) == set(a) and set(link_b) == set(b)
