import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from deploylens.llm import packing
from deploylens.llm import sentencepiece_codec as sc

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def digests(text, sp):
    ids = [1, *sp.encode(text), 2]
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_encoding_equals_the_library(odd, docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, docs):
        wanted = Counter((r["doc_id"], *digests(r["text"] or "", sp)) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r)[:4] for r in sc.digest_documents(df, PIECES).collect()) == wanted
    assert sc.digest_documents(none, PIECES).count() == 0


def test_own_merges_equal_the_library(docs):
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), sc.Codec(PIECES)
    for r in docs.select("text").limit(40).collect():
        assert c.pieces_of(c.plain(r["text"])) == sp.encode(r["text"])


def test_spans_cover_the_source(odd):
    for r in sc.encode_documents(odd, PIECES).collect():
        assert r["starts"][1:-1] == ([0, *r["ends"][1:-2]] if len(r["ids"]) > 2 else [])
        assert r["ends"] == sorted(r["ends"])
    c, text = sc.Codec(PIECES), "né ▁ 日\nx"
    ids, starts, ends = c.encode(text)
    data = text.encode()
    assert ends[-1] == len(data)
    assert b"".join(data[a:b] for a, b in zip(starts[1:-1], ends[1:-1], strict=True)) == data


def test_alignment_equals_the_walk_over_the_map():
    """The record of characters that stand for themselves is what the walk by longest prefix records."""
    import random

    rng, c = random.Random(4), sc.Codec(PIECES)
    for _ in range(300):
        text = "".join(rng.choice("ab ▁é日😀\n\t.Z\x00") for _ in range(rng.randint(0, 40)))
        made, record = c.aligned(text)
        walked, spans = c.normalise(text)
        assert made == walked and record.tolist() == [e for _, e in spans]
        ids, starts, ends = c.encode(text)
        data = text.encode()
        assert ends[-1] == len(data) and b"".join(data[x:y] for x, y in zip(starts[1:-1], ends[1:-1], strict=True)) == data
        for i, x, y in zip(ids[1:-1].tolist(), starts[1:-1], ends[1:-1], strict=True):
            if not c.is_byte[i]:  # a piece is its own source, but for the mark of a space
                assert c.pieces[i][0].replace("▁", " ").lstrip(" ") == data[x:y].decode().replace("▁", " ").lstrip(" ")


def charsmap(pairs):
    """A compiled map for single-byte sources, in the double-array layout."""
    strings, units = b"", {0: 1 << 10}
    for source, target in pairs:
        at = 1 ^ source
        units[at] = 256 << 10 | 256 | source
        units[at ^ 256] = len(strings) | 1 << 31
        strings += target + b"\0"
    size = 512
    return struct.pack(f"<I{size}I", 4 * size, *(units.get(k, 0) for k in range(size))) + strings


def test_longest_prefix_normalisation_records_the_source():
    m = sc.CharacterMap(charsmap([(ord("Q"), b"kw")]))
    assert m.longest(b"aQ", 1) == ("kw", 1) and m.longest(b"aQ", 0) is None
    c = sc.Codec(PIECES)
    c.charmap = m
    made, spans = c.normalise("aQb")
    assert made == "▁akwb" and spans == [(0, 0), (0, 1), (1, 2), (2, 2), (2, 3)]
    ids, starts, ends = c.encode("aQb")
    assert ends[-1] == 3 and [c.pieces[i][0] for i in ids[1:-1].tolist()] and max(ends) == 3


def test_packing_places_every_piece_once(odd, docs, none):
    tok = Tokenizer.from_file(WORDS)
    for df in (odd, docs):
        rows = packing.pack_documents(df, WORDS).collect()
        ids = [([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], r["doc_id"]) for r in df.select("doc_id", "text").collect()]
        wanted = Counter((d, k, k * 2048, len(x[k * 2048 : (k + 1) * 2048]), zlib.crc32(np.array(x[k * 2048 : (k + 1) * 2048], "<u4").tobytes())) for x, d in ids for k in range(-(-len(x) // 2048)))
        assert Counter(tuple(r)[:5] for r in rows) == wanted
        held = defaultdict(list)
        for r in rows:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in held.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(r["length"] for r in rows)
        assert len(held) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack_documents(none, WORDS).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for top in (40, 700, 2048):
        h = np.bincount(rng.integers(1, top + 1, 4000), minlength=2049)
        used = np.zeros(2049, int)
        made = packing.plan(h)
        for own, r in made:
            assert sum(own) <= 2048 and r > 0
            for n in own:
                used[n] += r
        assert (used == h).all()
        assert sum(r for _, r in made) <= np.ceil((h * np.arange(2049)).sum() / 2048) * 1.05 + 1


def test_words_are_remembered_within_bounds(monkeypatch):
    """Also where one text has more words than are kept; ids stay those of the library."""
    import public_tokenizers
    from deploylens.llm import packing

    monkeypatch.setattr(packing, "MEMO_PARTS", 50)
    t = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"W{k},it's{k} don'T_{k}<|endoftext|> É{k}\n\t{'x' * (k % 90)}" for k in range(200))
    for _ in range(2):
        assert t.ids(text) == packing.packed(t.tokenizer.encode(text, add_special_tokens=False).ids)
        assert len(t.memo) <= 50 and len(t.small) <= 50
        assert all(len(w) <= 64 for held in (t.memo, t.small) for w in held)
