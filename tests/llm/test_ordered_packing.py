import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deploylens.llm import ordered_packing as op

BYTES = public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b\t c", "One. Two!\nThree?  \"Four.\" five", "end.\n\n\nNext para.\r\nx", "it's we'll THEY'RE 3.14 x,y", "日本語。これは。 text", "naïve café… “so.” he", "\x1c. a\x1d b",
    "x<|endoftext|> y", "a b 　c. d", "tab\tsep \x85 nel", "😀 😀😀. ok", "word, word; word: word? word!", "ſ ǆ ɏ ʰ", "1234567 89.", "a.b.c. d", "..... ... . ", "é é̂ ñ", "nul\x00 x. \x7f y",
]


def test_ids_equal_the_library(docs):
    t, lib = op.ByteTokens(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(3)
    texts = CASES + [r["text"] for r in docs.select("text").collect()]
    texts += ["".join(rng.choice("ab .,\n!?\"'é日\t1 <　\x1e") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        data, cuts = t.encode(text)
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, "<u4").tolist() == ids, text
        assert cuts == sorted(cuts) and (not cuts or cuts[-1] <= len(ids))


def test_sentences_end_where_they_should():
    t, lib = op.ByteTokens(BYTES), Tokenizer.from_file(BYTES)
    for text in ('He said "no." Then 3.14 left.\nand went!  Bye', 'He said "no." Then 3.14 left.\nand went! Bye'):
        data, cuts = t.encode(text)
        ids = np.frombuffer(data, "<u4").tolist()
        assert [lib.decode(ids[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)] == ['He said "no."', " Then 3.14 left.", "\nand went!"]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        op.ByteTokens(public_tokenizers.path("word_bpe_49k.json"))


def cost_of(ends, cost, capacity):
    total, begin = 0, 0
    for e in ends:
        n = e - begin
        assert 0 < n <= capacity
        total += (0 if n & (n - 1) == 0 else capacity - n) + op.WINDOW_COST + (cost[e] if e != ends[-1] else 0)
        begin = e
    return total


def test_windows_cost_least():
    """Against the plain recursion over all windows."""
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice([8, 16, 64])
        at, p = [], 0
        for _ in range(rng.randint(1, 40)):
            p += rng.randint(1, capacity)
            at.append(p)
        cost = {a: rng.choice([0, 0, 8, 32]) for a in at}
        best = {0: 0}
        for j, e in enumerate(at):
            own = cost[e] if j + 1 < len(at) else 0
            best[e] = min(v + (0 if (e - b) & (e - b - 1) == 0 else capacity - e + b) + op.WINDOW_COST + own for b, v in best.items() if e - b <= capacity)
        ends = op.windows(np.array(at), np.array([cost[a] for a in at]), capacity)
        assert ends[-1] == at[-1] and cost_of(ends, cost, capacity) == best[at[-1]]


def checked(df, capacity=2048, **more):
    lib = Tokenizer.from_file(BYTES)
    pieces = op.pack_documents(df, BYTES, capacity, keep_ids=True, **more).collect()
    wanted = Counter((r["doc_id"], tuple([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in df.select("doc_id", "text").collect())
    by_sequence, whole = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    found = Counter()
    for (doc_id, n), held in whole.items():  # repeated rows follow each other
        ids = []
        for start, own in held:
            assert start == len(ids)
            ids += own
            if len(ids) == n:
                found[doc_id, tuple(ids)] += 1
                ids = []
    return pieces, wanted, found


def test_each_id_has_its_place(odd, docs, none):
    for df, capacity in ((odd.coalesce(1), 2048), (docs.coalesce(2), 2048), (odd.coalesce(1), 64)):
        _, wanted, found = checked(df, capacity)
        assert found == wanted
    assert op.pack_documents(none, BYTES).count() == 0


def test_little_padding_and_few_cuts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = op.pack_documents(df, BYTES).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.01 * sum(used.values())
    assert len(rows) - df.count() < len(used)  # no more cuts than windows


def test_a_stream_is_cut_as_it_comes(docs):
    """What is held is cut again and again: the windows still hold every id, and no more of them are needed."""
    whole = op.pack_documents(docs.coalesce(1), BYTES).collect()
    t = op.byte_tokens(BYTES)
    stream, out = op.Stream(0, 2048, False), []
    for r in docs.coalesce(1).select("doc_id", "text").collect():
        data, cuts = t.encode(r["text"])
        stream.add(r["doc_id"], data + b"\1\0\0\0", cuts)
        if stream.size >= 5000:
            out += stream.cut(False)
            assert stream.size <= 2048 + 1
    out += stream.cut(True)
    assert sum(p[2] for p in out) == sum(r["length"] for r in whole)
    assert len({p[5] for p in out}) < 1.3 * len({r["sequence_id"] for r in whole})
