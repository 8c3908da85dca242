"""The pipeline against a version in plain Python."""
import pyarrow as pa

import corpus_pipeline
from loadwatch.llm.mixing import mix
from loadwatch.llm.quality import measures

from .conftest import SMALL
from .test_decontaminate import by_hand as contaminated
from .test_secrets import by_hand as secrets_in
from .test_simhash import similar_groups


def test_stages(spark):
    sf = SMALL
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    made, now = [], docs
    for _, f in corpus_pipeline.STAGES:
        now = f(spark, now, sf)
        made.append(now.collect())
    assert all(set(r.asDict()) == set(docs.columns) for x in made[:4] for r in x)
    m = measures(pa.array([r["text"] for r in rows]))
    good = [r for i, r in enumerate(rows) if m["n_words"][i] >= 20 and 100 * m["n_repeat_words"][i] <= 30 * m["n_words"][i]]
    assert {r.doc_id for r in made[0]} == {r["doc_id"] for r in good}
    root = similar_groups([r["text"] for r in good])
    least = {}
    for r, g in zip(good, root):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    single = [r for r in good if r["doc_id"] in set(least.values())]
    assert {r.doc_id for r in made[1]} == {r["doc_id"] for r in single} and len(made[1]) == len(single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r for r in single if not contaminated(r["text"], items)[4]]
    assert {r.doc_id for r in made[2]} == {r["doc_id"] for r in clean} and 0 < len(clean) < len(single)
    after = {r.doc_id: r for r in made[3]}
    assert set(after) == {r["doc_id"] for r in clean}
    for r in clean:
        spans = secrets_in(r["text"])
        assert (after[r["doc_id"]].text == r["text"]) or spans or "[REDACTED]" in after[r["doc_id"]].text
        assert not secrets_in(after[r["doc_id"]].text) and after[r["doc_id"]].n_chars == len(after[r["doc_id"]].text)
    taken = {r.doc_id: r.taken for r in mix(spark.createDataFrame(made[3])).collect()}
    words = {}
    for r in made[4]:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.taken_words
    assert words == {k: v for k, v in taken.items() if v}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "copy", "taken_words", "position"} <= set(out.columns) and out.count() > 0
