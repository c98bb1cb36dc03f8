import random

import corpus_pipeline
from watchgrid.llm.queries import QUERIES


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("th er an in re on at en nd ou".split()) + str(rng.randrange(10**5)) for _ in range(n))
    bad = ["blarg", "snurf", "gronkel"]
    docs, labels, want = [], [], {}
    gone = {name: set() for name, _ in corpus_pipeline.STAGES[:4]}

    def add(text, stage=None, toxic=None):
        i = len(docs)
        docs.append((i, text, "en", f"src{i % 5}", len(text or ""), "extra"))
        if toxic is not None:
            labels.append((i, 1, toxic))
        if stage:
            gone[stage].add(i)
        return i

    for i in range(400):
        toxic = i % 5 == 0
        words = say(rng.randrange(30, 60)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        add(" ".join(words), "toxicity" if toxic else None, int(toxic))
    item = say(40)
    for _ in range(3):
        add(say(20) + " " + " ".join(item.split()[5:30]).upper() + " " + say(20), "decontamination")
    copy = say(80)
    add(copy)
    for _ in range(4):
        add(copy, "near-dedup")
        words = copy.split()
        words[rng.randrange(80)] = "changed"
        add(" ".join(words), "near-dedup")
    add("too short", "quality rules")
    add(None, "quality rules")
    add("a% b% c% d% e% f% g% h% i% j% k% l%", "quality rules")
    add("one two three four five six " * 9, "quality rules")
    docs.append((400, docs[400][1], "en", "src0", 0, "extra"))
    docs.append((docs[403][0], copy, "en", "src0", 0, "extra"))  # the same row twice
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string")
    d.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), sorted(r[0] for r in docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if name == "packing":
            break
        assert now.columns == d.columns
        left = [i for i in left if i not in gone[name]]
        if name == "near-dedup":
            left = sorted(set(left))
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == left, name
    packed = now.collect()
    assert sorted({r.doc_id for r in packed}) == left
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(whole) == digest(packed)
    d.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
