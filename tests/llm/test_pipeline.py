import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from codeatlas.llm import mixing, packing, toxicity



def shingles_of(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def first_of_near_copies(texts):
    """The smallest id of each group that pairs of a similarity of 0.8 or more connect, by comparing all pairs."""
    sets = {i: shingles_of(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (not sets[i] and not sets[j] or both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {root(i) for i in sets}


def test_near_copies_between_080_and_095_are_caught(spark):
    """Planted copies with some words changed, against all pairs; what is less alike stays."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, n = {}, 0
    for _ in range(40):
        base = [word() for _ in range(200)]
        texts[n] = " ".join(base)
        for changes in (1, 2, 3, 4, 12):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = word()
            n += 1
            texts[n] = " ".join(copy)
        n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    left = {r.doc_id for r in stage(spark, docs, "").collect()}
    want = first_of_near_copies(texts)
    assert left == want and 40 <= len(want) < 120


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns), name


def test_pipeline_matches_its_parts(spark, docs, rows, tmp_path):
    """Every stage against plain Python over the rows that it was given."""
    sf = str(tmp_path)
    toxic = [(1000 + i, f"you are a stupid idiot number {i} and a worthless clown too", "en", "a", 9, None, "", 0.0) for i in range(30)]
    plain = [(2000 + i, f"we are a friendly group of {i} people that walk in the park", "en", "b", 9, None, "", 0.0) for i in range(60)]
    spark.createDataFrame(rows + toxic + plain, docs.schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i in range(1000, 1030)] + [(i, 1, 0) for i in range(2000, 2060)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    given = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "source_mix", "packing"]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/{name}"
        stage(spark, given, sf).write.parquet(path)
        results[name] = (given, spark.read.parquet(path))
        given = results[name][1]
        if name != "packing":
            assert given.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.collect()}
    before, after = results["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    text = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == {i for i, t in text.items() if model.scores([(t or "").encode()])[0] < 0.5}
    assert len(ids(after) & set(range(1000, 1030))) < 5 and len(ids(after) & set(range(2000, 2060))) > 50
    before, after = results["exact_dedup"]
    least = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert ids(after) == set(least.values()) and after.count() == len(least)
    before, after = results["simhash_dedup"]
    assert ids(after) == first_of_near_copies({r.doc_id: r.text for r in before.collect()})
    before, after = results["source_mix"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in copies.items() if n})
    before, after = results["packing"]
    total, pieces = defaultdict(int), after.collect()
    for p in pieces:
        total[p.doc_id] += p.length
    n = Counter(r.doc_id for r in before.collect())
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert total == {i: n[i] * size[i] for i in n}
    assert sum(total.values()) <= packing.LENGTH * (max(p.sequence_id for p in pieces) + 1)
    rerun = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, rerun)) == sorted(map(str, pieces))
