import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from watchgrid.llm import alignment
from watchgrid.llm.vocabulary import byte_letters

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(texts, libraries):
    """Every A and B token pair whose byte ranges overlap, document by document."""
    a_lib, b_lib = libraries
    letter = {c: b for b, c in enumerate(byte_letters())}
    docs, corpus = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_parts = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in a]
        b_parts = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_parts) != (want := (" " + text).encode()) or b"".join(b_parts) != want:
            docs.append(None)
            continue
        spans = []
        for parts in (a_parts, b_parts):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for start, end in zip([0, *cuts], cuts):
            inside = [[str(i) for i, (x, y) in zip(ids, span) if start <= x and y <= end] for ids, span in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(",".join(side) for side in inside))
        links = []
        at = 0
        for i, (x, y) in zip(a, spans[0]):
            while spans[1][at][1] <= x:
                at += 1
            k = at
            while k < len(b) and spans[1][k][0] < y:
                links.append((i, b[k]))
                k += 1
        corpus.update(links)
        docs.append((a, b, groups, links))
    best = Counter()
    for (_, j), n in corpus.items():
        best[j] = max(best[j], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if d is None
        else (
            len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(corpus[x] == best[x[1]] for x in d[3]), sum(corpus[x] for x in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest(),
        )
        for d in docs
    ]


def make(seed, n=120):
    rng = random.Random(seed)
    words = "the Über naïve queeau ñandú ﬁne 漢字 🎉🎉 x=1; don't </s> <|endoftext|> [INST] 12345 ... ▁ \x00 \x85 ｆｕｌｌ é é thtionndble".split(" ")
    words += ["".join(rng.choice("abcdeﬁßéñ漢🎉'.,0123") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    gaps = [" "] * 20 + ["  ", "\n", "\n\n", "\t", " \n", " ", "　"]
    texts = [None, "", " ", "\n", "a", "  lead", "trail ", "\ttab", "same text here", "same text here", "x" * 5000, " " * 500, "word " * 3000]
    texts += ["<s> <unk> </s>", "<0x41>", "▁a", "line one\nline two\nthree"]
    for _ in range(n):
        plain = rng.random() < 0.5
        texts.append("".join(rng.choice(words) + (rng.choice([" "] * 9 + ["\n"]) if plain else rng.choice(gaps)) for _ in range(rng.randrange(1, 60))))
        if plain:
            texts[-1] = texts[-1].strip()
    return texts


@pytest.mark.parametrize("seed,block_bytes,stretch", [(1, 2_000_000, 256), (2, 900, 256), (3, 20_000, 3)])
def test_equal_to_brute_force_at_any_block_and_stretch(spark, libraries, monkeypatch, seed, block_bytes, stretch):
    monkeypatch.setattr(alignment.Aligned.__init__, "__defaults__", (stretch,))
    texts = make(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block int").repartition(3)
    got = alignment.align_tokenizers(docs, RANKS, PIECES, block_bytes=block_bytes).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.row.doc_id)] == brute(texts, libraries)


def test_walkers_agree_with_one_walk():
    rng = np.random.default_rng(3)
    total = 4000
    ends = [np.unique(np.r_[rng.integers(1, total, 900), total]) for _ in range(2)]
    one = alignment.lockstep(*ends, np.array([0]), total)
    for stretch in (1, 2, 7, 100):
        many = alignment.lockstep(*ends, np.array([0]), stretch)
        assert all((x == y).all() for x, y in zip(one, many))


def test_empty_table_null_ids_and_empty_blocks(spark):
    schema = "doc_id long, text string"
    assert alignment.align_tokenizers(spark.createDataFrame([], schema), RANKS, PIECES).count() == 0
    got = alignment.align_tokenizers(spark.createDataFrame([(None, None), (1, "")], schema), RANKS, PIECES).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 0, 0, 0, 0, "")] * 2
