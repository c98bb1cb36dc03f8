import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchgrid.llm.packing import best_fit, led_by_complements, pack, pack_documents, plan, sequences, tokenise
from watchgrid.llm.token_counts import count_tokens
from watchgrid.session import cut_lineage

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n", "a\nb", "a\n\nb\n", "two  blanks", "tab\there", " lead and trail ", "x<|endoftext|>y <|endoftext|>",
    "don't we'll 's", "été ßüö 日本語 🙂🙂", "1234 5,678.90!!! ???", "a b c\x1cd\x85e", "word " * 3000, "z" * 5000, "same", "same",
    "Sthe.\nTo ing on, and ththeder it wh ti anthth by.", "\r\nline\r\n", "é combining",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    alphabet = "ab ,.\n'sé1 \t"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i % 210, t, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs, library):
    got = sorted(tuple(r) for r in count_tokens(docs, JSON).select("row.doc_id", "n_bytes", "n_tokens").collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), len(library(r.text))) for r in docs.collect())
    assert count_tokens(docs.limit(0), JSON).count() == 0


def test_pieces_and_sequences_round_trip(docs, library):
    pieces = cut_lineage(tokenise(docs, RANKS, JSON, 2, 1024))
    packed = pack(pieces, 1024)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(library(r.text) + [2])
    got = defaultdict(list)
    by_sequence = defaultdict(dict)
    for r in packed.collect():
        ids = array("I", bytes(r.ids)).tolist()
        assert len(ids) == r.length <= 1024
        got[r.row.doc_id].append((r.start, ids))
        by_sequence[r.sequence_id][r.offset] = ids
    for doc_id, texts in want.items():
        assert sorted(sum((i for _, i in sorted(got[doc_id])), [])) == sorted(sum(texts, []))
    built = {r.sequence_id: array("I", bytes(r.ids)).tolist() for r in sequences(packed).collect()}
    for key, parts in by_sequence.items():
        assert built[key] == sum((parts[o] for o in sorted(parts)), []) and len(built[key]) <= 1024
        assert sorted(parts) == [sum(len(parts[p]) for p in parts if p < o) for o in sorted(parts)]
    total = sum(len(i) for t in want.values() for i in t)
    assert len(built) <= -(-total // 1024) + 1
    first = pack_documents(docs.where("doc_id = 14"), RANKS, JSON).orderBy("piece").collect()
    assert first[0].length == sum(r.length for r in first) % 1024 and all(r.length == 1024 for r in first[1:])
    assert first[0].ids_crc32 == zlib.crc32(array("I", want[14][0][: first[0].length]).tobytes())
    assert pack_documents(docs.limit(0), RANKS, JSON).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(2000):
        counts[rng.choice([rng.randrange(1, 1025), rng.randrange(1, 200), 600 if seed == 3 else 512])] += rng.choice([1, 1, 1000 if seed > 5 else 1])
    used, total = defaultdict(int), 0
    for pattern, times in plan(counts, 1024):
        assert sum(pattern) <= 1024 and times > 0
        total += times
        for length in pattern:
            used[length] += times
    assert used == counts
    bound = max(-(-sum(k * n for k, n in counts.items()) // 1024), sum(n for k, n in counts.items() if k > 512))
    assert total <= bound * 1.02 + 1


@pytest.mark.parametrize("low, high", [(1, 1024), (200, 700), (1, 120), (500, 1024)])
def test_plan_is_no_longer_than_complements_alone_or_best_fit_alone(low, high):
    rng = random.Random(low)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[rng.randint(low, high)] += 1
    size = lambda found: sum(times for _, times in found)
    made = size(plan(counts, 1024))
    assert made <= size(led_by_complements(counts, 1024))
    assert made <= size(best_fit([counts.get(n, 0) for n in range(1025)], 1024))
