"""The corpus pipeline, stage by stage, against plain versions of what each stage does."""

import array

import numpy as np
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F
from tests_support import prose, shingle_set

import corpus_pipeline
from tidemill.llm import mixing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write_tables(spark, at):
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(160):
        words = prose(rng, 50).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, 50, 5):
                words[k] = str(rng.choice(["vileword", "nastyslur", "hatefulterm"]))
        if i % 10 == 3:
            words[7] = f"me{i}@mail.example.com"
        rows.append([i, " ".join(words), "en", f"s{i % 3}"])
        labels.append((i, 1, int(toxic)))
    rows += [[1000 + i, rows[i][1].upper() if i % 2 else rows[i][1] + " end", "en", None] for i in range(1, 40)]
    rows += [[2000, None, None, "s0"], [2001, "", "en", "s1"], [2002, "few", "en", "s2"]]
    docs = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return {r[0]: r for r in docs}, {i: t for i, _, t in labels}


def components_of(sets):
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] > comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    old, new = comp[a], comp[b]
                    comp = {i: new if c == old else c for i, c in comp.items()}
                    changed = True
    return comp


def test_stages(spark, tmp_path):
    sf = f"file://{tmp_path}"
    all_docs, toxic = write_tables(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def step(name, docs):
        stages[name](spark, docs, sf).write.parquet(f"{sf}/out-{name.replace(' ', '-')}")
        return spark.read.parquet(f"{sf}/out-{name.replace(' ', '-')}")

    calm = step("toxicity", docs)
    assert calm.columns == COLUMNS
    left = {r.doc_id: r for r in calm.collect()}
    assert np.mean([(i in left) != bool(t) for i, t in toxic.items()]) > 0.95
    assert all(tuple(r) == tuple(all_docs[i]) for i, r in left.items()) and 2000 in left

    single = step("near duplicates", calm)
    comp = components_of({i: shingle_set(r.text) for i, r in left.items()})
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == sorted({c for c in comp.values()})

    masked = step("personal data", single)
    scan = pii.Scanner()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        assert r.text == pii.redact(before[r.doc_id], scan.spans(before[r.doc_id])) and r.n_chars == (None if r.text is None else len(r.text))
    assert masked.where(F.contains("text", F.lit("[EMAIL]"))).count() > 3 and masked.columns == COLUMNS

    mixed = step("mixing", masked)
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect()}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n} and mixed.columns == COLUMNS

    encoded = step("encoding", mixed)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in encoded.collect():
        assert bytes(r.ids) == array.array("I", library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids).tobytes()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in encoded.collect())
